"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates that pass their validity check (Luhn, ISO 7064 mod 97, octet range, calendar, ...) are
mapped to an index within the values that have the same format, the index is permuted by a Feistel
network under a secret key (with cycle walking to stay inside the domain), and the result is written in
the same format with fresh check digits. The permutation depends on the key and the format alone, so
equal values stay linked across documents, and different values stay different. ``restore=True`` undoes
it value by value; a whole text comes back where its values stand apart, as a pseudonym beside other
digits may read differently.

What stays in clear: dates outside of 1900 to 2099, the first digit of phone numbers, the domain of mail
addresses and the punctuation of their local part (so a local part of punctuation alone), country letters
of IBANs, and whatever fails its validity check.

Defined cases: null text stays null with zero counts; empty text stays empty; texts are processed
whole; repeated rows are returned one by one; a null id is returned as null; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "iban", "ssn", "date", "phone")
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
_ALNUM = "abcdefghijklmnopqrstuvwxyz"
#: The expressions that find candidates, in order of precedence.
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,24})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d-]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[\x20-]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{1,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d))",
    re.ASCII,
)
_HINT = re.compile(r"@|\d", re.ASCII)


def feistel(value: int, size: int, key: bytes, tag: str, back: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of 0..size-1; ``back`` inverts it."""
    if size < 2:
        return value
    side = isqrt(size - 1) + 1
    salt = f"{tag}/{size}/".encode()

    def f(r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(salt + f"{r}/{x}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        left, right = divmod(value, side)
        for r in reversed(range(rounds)) if back else range(rounds):
            if back:
                left, right = (right - f(r, left)) % side, left
            else:
                left, right = right, (left + f(r, right)) % side
        value = left * side + right
        if value < size:
            return value


def _digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym in the same format, or None if the value isn't valid for its kind."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        if _luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        new = str(feistel(int(digits[:n]), 10**n, key, f"card{n}", back)).zfill(n)
        return _digits(text, new + str((10 - _luhn(new + "0")) % 10))
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        new = feistel(int.from_bytes(bytes(octets), "big"), 2**32, key, "ip", back)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "ssn":
        a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        index = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
        rest, s = divmod(feistel(index, 898 * 99 * 9999, key, "ssn", back), 9999)
        a, g = divmod(rest, 99)
        return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{s + 1:04}"
    if kind == "date":
        try:
            if text[4:5] == "-":
                order, parts = "ymd", text.split("-")
                day = date(*map(int, parts))
            else:
                sep = "/" if "/" in text else "."
                x, y, year = map(int, text.split(sep))
                order = "dmy" if y <= 12 else "mdy"
                day = date(year, y, x) if order == "dmy" else date(year, x, y)
        except ValueError:
            return None
        if not 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
            return None
        if order == "ymd":
            new = date.fromordinal(_FIRST_DAY + feistel(day.toordinal() - _FIRST_DAY, _DAYS, key, "ymd", back))
            return new.isoformat()
        # day-first and month-first dates keep the reading that their numbers allow: both permute within
        # their own set of dates, so that a pseudonym reads back as it was written
        while True:
            day = date.fromordinal(_FIRST_DAY + feistel(day.toordinal() - _FIRST_DAY, _DAYS, key, order, back))
            if order == "dmy" or day.day > 12:
                break
        pair = (day.day, day.month) if order == "dmy" else (day.month, day.day)
        width = 2 if len(text.split(sep)[0]) == 2 and len(text.split(sep)[1]) == 2 else 1
        return f"{pair[0]:0{width}}{sep}{pair[1]:0{width}}{sep}{day.year}"
    if kind == "iban":
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        own = [c for c in flat[4:] if c.isdigit()]
        new = str(feistel(int("".join(own) or "0"), 10 ** len(own), key, f"iban{len(own)}", back)).zfill(len(own))
        bban = _digits(flat[4:], new) if own else flat[4:]
        flat = f"{flat[:2]}{98 - _mod97(bban + flat[:2] + '00'):02}{bban}"
        it = iter(flat)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        keep = 1  # the first digit, so that the number's length and start stay valid
        n = len(digits) - keep
        return _digits(text, digits[:keep] + str(feistel(int(digits[keep:]), 10**n, key, f"phone{n}", back)).zfill(n))
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local]
        value, size = 0, 1
        for c, n in zip(local, sizes, strict=True):
            value = value * n + (_ALNUM.index(c.lower()) if n == 26 else int(c) if n == 10 else 0)
            size *= n
        shape = "".join("a" if n == 26 else "0" if n == 10 else c for c, n in zip(local, sizes, strict=True))
        value = feistel(value, size, key, f"email{shape}@{domain.lower()}", back)
        out = []
        for c, n in zip(reversed(local), reversed(sizes), strict=True):
            value, d = divmod(value, n)
            out.append(c if n == 1 else str(d) if n == 10 else _ALNUM[d].upper() if c.isupper() else _ALNUM[d])
        return "".join(reversed(out)) + "@" + domain
    raise ValueError(kind)


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values found in the input."""
    if not _HINT.search(text):
        return text, []
    out, found, done = [], [], 0
    at = 0
    while m := _FIND.search(text, at):
        new = pseudonym(m.lastgroup, m[0], key, back)
        if new is None and m.lastgroup != "phone":  # another kind may fit at the same place
            new, kind, end = _other(text, m, key, back)
        else:
            kind, end = m.lastgroup, m.end()
        if new is None:
            at = m.start() + 1
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():
                at += 1  # no value starts inside a run of digits
            continue
        out += [text[done : m.start()], new]
        found.append((kind, m.start(), end))
        done = at = end
    return "".join([*out, text[done:]]), found


def _other(text: str, m: re.Match, key: bytes, back: bool) -> tuple[str | None, str, int]:
    for kind, pattern in _SINGLE.items():
        if kind != m.lastgroup and (x := pattern.match(text, m.start())) and (new := pseudonym(kind, x[0], key, back)) is not None:
            return new, kind, x.end()
    return None, "", 0


def _singles() -> dict[str, re.Pattern]:
    parts = re.split(r"\|?(?=\(\?P<)", _FIND.pattern)
    return {re.match(r"\(\?P<(\w+)>", p)[1]: re.compile(p, re.ASCII) for p in parts if p}


_SINGLE = _singles()


def pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", restore: bool = False) -> DataFrame:
    """Per document: doc_id, text with pseudonyms, spans (kind:start:end in the input) and a count per kind."""
    key = hashlib.sha256(key).digest()
    fields = [("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS)]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, counts = [], [], {k: [] for k in KINDS}
            for t in batch.column(1):
                new, found = (None, []) if (s := t.as_py()) is None else pseudonymize(s, key, restore)
                texts.append(new)
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
                for k in KINDS:
                    counts[k].append(sum(f[0] == k for f in found))
            cols = [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS)]
            yield pa.record_batch(cols, schema=schema)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, text string, spans string, {kinds}")
