"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived: an
OR of clauses, each an AND of lower-case trigrams that any match must contain. Postings (trigram,
document) are stored for the trigrams that the queries mention, clauses are answered by intersecting
postings, and only the candidates are verified with the expression. A rule without mandatory trigrams
scans every text.

Defined cases: null text counts as empty; repeated rows are scanned and returned one by one; rows with a
null id are always verified; an empty table gives an empty result; other input columns are not read.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize, split_by_slots


@dataclass(frozen=True)
class Rule:
    """kind; pattern; group whose length must reach least; whether letters match in either case."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The rules' expressions. The first three are the base kinds.
RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghp", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)
BASE_KINDS = ("assign", "access", "hex")
_MOST = 64


def trigram_clauses(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match contains; None if there are none."""

    def strings(tree) -> list[tuple]:
        """Alternatives, each a tuple of literal pieces; None stands for unknown text between them."""
        outs: list[tuple] = [("",)]
        for op, arg in tree:
            if op is C.LITERAL:
                step = [(chr(arg).lower(),)]
            elif op is C.IN and arg[0][0] is not C.NEGATE:
                chars: set[str] = set()
                for kind, v in arg:
                    if kind is C.LITERAL:
                        chars.add(chr(v).lower())
                    elif kind is C.RANGE and v[1] - v[0] < 8:
                        chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                    else:
                        chars = set(map(chr, range(99)))
                        break
                step = [(c,) for c in sorted(chars)] if len(chars) <= 4 else [("", None, "")]
            elif op is C.SUBPATTERN:
                step = strings(arg[3])
            elif op is C.BRANCH:
                step = [s for b in arg[1] for s in strings(b)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, sub = arg
                inner = strings(sub)
                if (low, high) == (0, 1) and len(inner) <= 4:
                    step = [("",), *inner]
                elif low == high == 1:
                    step = inner
                elif low >= 1:
                    step = [(*s, None, "") for s in inner]
                else:
                    step = [("", None, "")]
            else:
                step = [("", None, "")]
            if len(outs) * len(step) > _MOST:
                step = [("", None, "")]
            outs = list(dict.fromkeys((*o[:-1], o[-1] + s[0], *s[1:]) for o in outs for s in step))
        return outs

    clauses = []
    for pieces in strings(P.parse(pattern)):
        grams = frozenset(p[i : i + 3] for p in pieces if p for i in range(len(p) - 2))
        if not grams:
            return None
        clauses.append(grams)
    clauses = list(dict.fromkeys(clauses))
    return [c for c in clauses if not any(o < c for o in clauses)]


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the rule's matches: the text is split at the matches, so that the
    lengths of the pieces and of the matches add up to their places."""
    regex = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    keys = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else hits
    zipped = F.zip_with(hits, keys, lambda h, k: F.struct(F.length(h).alias("n"), F.length(k).alias("k")))
    rows = F.zip_with(F.slice(gaps, 1, F.size(hits)), zipped, lambda g, z: F.struct(g.alias("g"), z["n"].alias("n"), z["k"].alias("k")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    placed = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, r: F.struct(
            (a["at"] + r["g"] + r["n"]).alias("at"),
            F.when(
                r["k"] >= rule.least,
                F.concat(a["out"], F.array(F.struct((a["at"] + r["g"]).alias("start"), (a["at"] + r["g"] + r["n"]).alias("end")))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.regexp_like(text, regex), placed).otherwise(empty)


def _tagger(rank: Column, kind: Column):
    return lambda s: F.struct(s["start"].alias("start"), rank, kind, s["end"].alias("end"))


#: Up to so many trigrams a text is searched for each; with more, its own trigrams are listed once.
SCANS = 64


def trigram_postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text", scans: int = SCANS) -> DataFrame:
    """(gram, doc_id): the inverted index of the given lower-case trigrams."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    wanted = [F.lit(g) for g in grams]
    if len(grams) <= scans:
        found = F.filter(F.array(*[F.when(F.contains(F.col("low"), g), g) for g in wanted]), lambda g: g.isNotNull())
    else:
        # a look-ahead matches at every place, so that the trigrams overlap
        found = F.array_intersect(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)), F.array(*wanted))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("low")).select("doc_id", F.explode(found).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): per document the indexed rules of which some clause has all its trigrams."""
    spark = postings.sparkSession
    rows = [(r.kind, n, g, len(c)) for r in rules for n, c in enumerate(trigram_clauses(r.pattern) or []) for g in sorted(c)]
    clauses = spark.createDataFrame(rows, "kind string, clause int, gram string, need int")
    # the clause table comes from the rules' text alone, a few dozen rows whatever the data
    met = postings.join(F.broadcast(clauses), "gram").groupBy("doc_id", "kind", "clause", "need").agg(F.count_distinct("gram").alias("have"))
    return met.filter("have = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and found, an array of (start, kind order, kind, end) by start, then kind."""
    indexed = {r.kind for r in rules if trigram_clauses(r.pattern)}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if indexed:
        grams = sorted({g for r in rules if r.kind in indexed for c in trigram_clauses(r.pattern) for g in c})
        postings = materialize(trigram_postings(docs, grams, id_col, text_col), "postings")
        found = materialize(candidates(postings, rules).withColumnRenamed("doc_id", "cand_id"), "candidates")
        discard(postings)
        # the texts of documents that are surely no candidates pass without a shuffle
        likely, rest = split_by_slots(rows, F.col("doc_id"), found, F.col("cand_id"))
        likely = likely.join(found, F.col("doc_id") == F.col("cand_id"), "left").select("doc_id", "text", "kinds")
        rows = likely.unionByName(rest.withColumn("kinds", F.lit(None).cast("array<string>")))
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    per_kind = []
    for n, rule in enumerate(rules):
        rank, kind = F.lit(n).alias("rank"), F.lit(rule.kind).alias("kind")
        tagged = F.transform(_spans(F.col("text"), rule), _tagger(rank, kind))
        if rule.kind in indexed:
            none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
            tagged = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.col("doc_id").isNull()), tagged).otherwise(none)
        per_kind.append(tagged)
    return rows.select("doc_id", F.sort_array(F.concat(*per_kind)).alias("found"))


def span_digest(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
