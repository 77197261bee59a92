"""Quality classifier: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes. Each byte has an embedding; filters of ``WIDTH`` bytes slide over the whole text at every
byte. The text is worked on in chunks of ``CHUNK`` windows, and a chunk's windows reach into the next chunk, so
chunks overlap and no window is left out. Each filter's largest response in a chunk is kept; the chunks' responses are
combined by their mean and by their maximum, and a logistic layer turns both into one probability. Memory is that
of a slice of the text and of two rows per text, whatever its length.

Training is plain gradient descent (Adam) on a bounded sample: at most ``most`` labelled documents of the training folds, by
a hash of the id, texts of up to ``longest`` bytes. Gradients flow to the window that gave a chunk's maximum, so a
step costs little more than scoring. It is deterministic. Labels, language, source and id are never inputs.

Defined cases: null text counts as empty; an empty text has no windows and is scored by its zero features, like any
other; texts shorter than a filter are followed by padding. Repeated rows are scored one by one; a null doc_id is in no
held-out fold and has no label. A document with several labels counts by the least; null labels don't count. Without labels of
both kinds the score is the share of ones, smoothed, which is 0.5 without labels. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernel import slices, text_buffer, trim

WIDTH, EMBED, FILTERS, CHUNK = 8, 6, 24, 512
#: Bytes that a worker scores at a time.
_SLICE = 500_000
_PAD = 256


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def layout(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, real, chunk starts, text of each chunk): texts one after the other, each padded by WIDTH - 1 places
    and up to a whole number of groups of WIDTH places. real: places of text; starts: in groups."""
    n = np.diff(offs)
    groups = np.where(n > 0, -(-(n + WIDTH - 1) // WIDTH), 0)
    first = np.concatenate(([0], np.cumsum(groups)))
    shift = np.repeat(first[:-1] * WIDTH - offs[:-1], n)
    at = np.arange(len(buf)) + shift
    codes = np.full(first[-1] * WIDTH + WIDTH, _PAD, np.int16)
    real = np.zeros(first[-1] * WIDTH, bool)
    codes[at], real[at] = buf, True
    chunks = -(-n // CHUNK)
    text = np.repeat(np.arange(len(n)), chunks)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return codes, real, first[text] + inside * (CHUNK // WIDTH), text


class Network:
    def __init__(self, embed: np.ndarray, filters: np.ndarray, bias: np.ndarray, weight: np.ndarray, offset: float, prior: float | None = None):
        self.embed, self.filters, self.bias, self.weight, self.offset, self.prior = embed, filters, bias, weight, offset, prior

    @classmethod
    def constant(cls, prior: float) -> Network:
        z = np.zeros
        return cls(z((257, EMBED), np.float32), z((WIDTH * EMBED, FILTERS), np.float32), z(FILTERS, np.float32), z(2 * FILTERS, np.float32), 0.0, prior)

    @classmethod
    def new(cls, rng: np.random.Generator, prior: float) -> Network:
        draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
        embed = draw(257, EMBED) * 0.5
        embed[_PAD] = 0
        return cls(embed, draw(WIDTH * EMBED, FILTERS) * (2 / (WIDTH * EMBED)) ** 0.5, np.zeros(FILTERS, np.float32), draw(2 * FILTERS) * 0.1, float(np.log(prior / (1 - prior))))

    def chunk_maxima(self, codes: np.ndarray, real: np.ndarray, starts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(largest response of each filter in each chunk, place of that window if asked for).

        Windows that start at the same place of their groups lie side by side, so each of the WIDTH phases is one
        matrix product without a copy."""
        x = self.embed[codes]
        groups = len(real) // WIDTH
        best, phase = None, None
        for p in range(WIDTH):
            out = x[p : p + groups * WIDTH].reshape(groups, WIDTH * EMBED) @ self.filters
            out[~real[p::WIDTH]] = -np.inf
            if best is None:
                best, phase = out, np.zeros(out.shape, np.int8) if where else None
            elif where:
                more = out > best
                phase[more] = p
                best = np.where(more, out, best)
            else:
                np.maximum(best, out, out=best)
        top = np.maximum.reduceat(best, starts, axis=0)
        if not where:
            return top, None
        chunk = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, groups)))
        hit = np.where(best == top[chunk], np.arange(groups)[:, None], groups)
        row = np.minimum.reduceat(hit, starts, axis=0)
        return top, row * WIDTH + np.take_along_axis(phase, row, axis=0)

    def combine(self, top: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, active, chunks of each text): mean and maximum of the chunks' responses above the bias."""
        active = np.maximum(top + self.bias, 0)
        many = np.bincount(text, minlength=texts)
        out = np.zeros((texts, 2 * FILTERS), np.float32)
        if len(text):
            cut = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            out[text[cut], :FILTERS] = np.add.reduceat(active, cut, axis=0) / many[text[cut], None]
            out[text[cut], FILTERS:] = np.maximum.reduceat(active, cut, axis=0)
        return out, active, many

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A probability for each text."""
        texts = len(offs) - 1
        if self.prior is not None:
            return np.full(texts, self.prior)
        out = np.zeros((texts, 2 * FILTERS), np.float32)
        for i, j, part, at in slices(buf, offs, _SLICE):
            if j - i == 1 and len(part) > 2 * _SLICE:
                out[i] = self._long(part)
            elif len(part):
                codes, real, starts, text = layout(part, at)
                out[i:j] = self.combine(self.chunk_maxima(codes, real, starts)[0], text, j - i)[0]
        return sigmoid(out.astype(float) @ self.weight.astype(float) + self.offset)

    def _long(self, text: np.ndarray) -> np.ndarray:
        """Features of one long text, a run of whole chunks at a time; each run reaches WIDTH - 1 bytes into the next."""
        step = _SLICE // CHUNK * CHUNK
        total, high, chunks = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for a in range(0, len(text), step):
            part = text[a : a + step + WIDTH - 1]
            codes, real, starts, _ = layout(part, np.array([0, len(part)]))
            real[min(step, len(part)) :] = False
            starts = starts[: -(-min(step, len(part)) // CHUNK)]
            active = np.maximum(self.chunk_maxima(codes, real, starts)[0] + self.bias, 0)
            total, high, chunks = total + active.sum(0, dtype=float), np.maximum(high, active.max(0)), chunks + len(active)
        return np.concatenate([total / chunks, high]).astype(np.float32)

    def gradients(self, buf: np.ndarray, offs: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        codes, real, starts, text = layout(buf, offs)
        texts = len(label)
        if len(starts):
            top, place = self.chunk_maxima(codes, real, starts, where=True)
        else:
            top, place = np.zeros((0, FILTERS), np.float32), np.zeros((0, FILTERS), np.int64)
        feats, active, many = self.combine(top, text, texts)
        err = ((sigmoid(feats @ self.weight + self.offset) - label) / texts).astype(np.float32)
        back = err[:, None] * self.weight
        grad = back[text, :FILTERS] / np.maximum(many[text], 1)[:, None]
        grad = (grad + back[text, FILTERS:] * (active == feats[text, FILTERS:])) * (active > 0)
        chunk, f = np.nonzero(grad)
        g, seen = grad[chunk, f], codes[place[chunk, f][:, None] + np.arange(WIDTH)]
        windows = self.embed[seen].reshape(len(g), WIDTH * EMBED)
        to_filters, to_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for k in range(FILTERS):
            own = f == k
            to_filters[:, k] = g[own] @ windows[own]
        spread = (g[:, None] * self.filters.T[f]).reshape(-1, EMBED)
        for e in range(EMBED):
            to_embed[:, e] = np.bincount(seen.ravel(), spread[:, e], minlength=257)
        to_embed[_PAD] = 0
        return [to_embed, to_filters, grad.sum(0), err @ feats, np.float32(err.sum())]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Network:
    """A network fitted to whole texts with labels 0 or 1."""
    prior = (float(labels.sum()) + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Network.constant(prior)
    rng = np.random.default_rng(seed)
    net = Network.new(rng, prior)
    names = ("embed", "filters", "bias", "weight", "offset")
    first, second, step = [0.0] * len(names), [0.0] * len(names), 0
    epochs = max(epochs, min(60, -(-300 * batch // len(labels))))  # small samples get as many steps as they need
    steps = epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            offs = np.concatenate(([0], np.cumsum([len(texts[t]) for t in mine])))
            buf = np.frombuffer(b"".join([texts[t] for t in mine]), np.uint8)
            step += 1
            slow = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, (name, g) in enumerate(zip(names, net.gradients(buf, offs, labels[mine]), strict=True)):
                g = g + 1e-4 * getattr(net, name) if name in ("filters", "weight") else g
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                move = slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - move).astype(np.float32) if name != "offset" else float(net.offset - move))
    return net


def training_rows(docs: DataFrame, labels: DataFrame, most: int, longest: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """(texts, labels): at most ``most`` documents outside the held-out fold, by a hash of the id."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    n, place = known.count(), F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    # rows that surely come later are left out before the rest is sorted; there is some slack for chance
    edge = int((1 << 31) * min(1.0, (most + 8 * most**0.5 + 100) / max(1, n)))
    drawn = known.filter(place < edge).groupBy("id").agg(F.min("label").alias("label")).orderBy(place, "id").limit(most)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter(F.octet_length("text") <= longest)
    held = rows.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).toArrow().sort_by("id")
    return [t.encode() for t in held["text"].to_pylist()], held["label"].to_numpy().astype(np.float32)


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(sent.value.score(*text_buffer(batch.column(1))))], names=["doc_id", "score"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, most: int = 3000, longest: int = 65_536, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``threshold`` on). Fitted on at most ``most`` labelled
    documents of at most ``longest`` bytes, whose texts pass the driver."""
    net = fit(*training_rows(docs, labels, most, longest))
    scored = score_quality(docs, net)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
