"""Operator 5: document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words, all of them. A passage runs from its first word to the next passage's, the last
one to the end of the text, so a text's score depends on nothing beside it. A passage becomes a vector of form features (classes of
characters, lengths, repetition); a small layer encodes it; gated attention, tanh times sigmoid, weighs the passages of a
document; their weighted sum gives the score. All weights are learned together from document labels. Labels are used only
of rows whose crc32(doc_id as text) mod 3 is not 1, and of those at most SAMPLE_PER_LABEL of each label (a bounded sample,
the smallest by a hash of the id, and of each one text of at most SAMPLE_PASSAGES passages, evenly spread over longer ones);
the true share of the labels corrects the score's offset. Every passage of every text is scored.

Cases: null and empty texts are one passage without words and get a score too; a text of any length is scored as a
whole; a null id counts as not held out and has no label; several labels of one id count as the smallest, of several
texts of one id the one with the smallest features is learned from; null labels do not count; without labels of both kinds every score is their share (0.5 without any). Equal texts get equal scores; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, remainder, small_batches, table, utf8

PASSAGE_WORDS = 64
#: The bound of the sample that is learned from, of each label.
SAMPLE_PER_LABEL = 1500
#: The bound of passages that are learned from, of each text.
SAMPLE_PASSAGES = 256
HIDDEN, ATTENTION, EPOCHS, SEED = 16, 8, 80, 11
#: Bytes of texts that are turned into features at once.
SLICE_BYTES = 4 << 20

#: Classes of bytes.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!", "$#%*&@^~=<>{}[]\\/_+", ".,;:?", "'\"()-", "\n"]
_CLASS = np.full(256, 10, np.uint8)
_CLASS[128:] = 9
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(256)], np.uint64)
N_FEATURES = 10 + 9


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, first passage of each text), all passages of all texts in order."""
    if not texts:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    of = np.searchsorted(text_at, starts, side="right") - 1  # the text of each word
    n_words = np.bincount(of, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    x = np.zeros((total, N_FEATURES), np.float32)
    x[first[n_words == 0], 18] = 1.0
    if not len(starts):
        return x, first
    word_first = np.cumsum(n_words) - n_words
    passage = first[of] + (np.arange(len(starts)) - word_first[of]) // PASSAGE_WORDS
    heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    which, at = passage[heads], starts[heads]
    cls = _CLASS[buf]
    # A passage ends where the next one of its text begins, or with its text and one line end.
    owner = of[heads]
    text_end = np.append(text_at[1:], len(buf))[owner]
    until = np.where(np.append(owner[1:] == owner[:-1], False), np.append(at[1:], 0), text_end)
    size = (until - at).astype(np.float32)
    bounds = np.column_stack([at, until]).ravel()
    for k in range(10):
        x[which, k] = np.add.reduceat(np.append(cls == k, False), bounds, dtype=np.int64)[::2] / size
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    length = ends - starts
    # A word's hash: its bytes by powers of a constant, summed. Very long words repeat the powers.
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    code = np.add.reduceat((buf[inside].astype(np.uint64) + np.uint64(1)) * _POWER[place & 255], np.cumsum(length) - length)
    words = np.diff(np.append(heads, len(starts))).astype(np.float32)
    sums = lambda v: np.add.reduceat(v, heads, dtype=np.float64)
    again = np.append(False, code[1:] == code[:-1])
    again[heads] = False
    key = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (code >> np.uint64(32)))
    fresh = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=total)
    last = cls[ends - 1]
    caps = cls[starts] == 1
    x[which, 10] = distinct[which] / words
    x[which, 11] = sums(again) / words
    x[which, 12] = sums(length) / words / 10
    x[which, 13] = np.sqrt(np.maximum(0, sums(length.astype(np.float64) ** 2) / words - (sums(length) / words) ** 2)) / 10
    x[which, 14] = sums(caps) / words
    x[which, 15] = sums((last >= 4) & (last <= 5)) / words
    x[which, 16] = sums(last == 6) / words
    x[which, 17] = words / PASSAGE_WORDS
    return x, first


def _spread(x: np.ndarray, most: int = SAMPLE_PASSAGES) -> np.ndarray:
    """At most that many of a text's passages, evenly spread, the first and the last included."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(np.int64)]


class Model:
    """Encoder, gated attention and output, as numpy arrays."""

    def __init__(self, share: float = 0.5) -> None:
        self.w: dict[str, np.ndarray] | None = None
        self.share, self.shift = share, 0.0

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        z = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        s = (t * g) @ w["a"]
        n = np.diff(np.append(first, len(x)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        m = np.add.reduceat(a[:, None] * z, first, axis=0)
        return z, t, g, a, n, m, m @ w["o"] + w["c"]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = ((x - self.mean) / self.scale).clip(-6, 6).astype(np.float64)
        r = np.random.default_rng(SEED)
        shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "c": (1,)}
        self.w = {k: r.normal(0, 0.3 if len(s) > 1 else 0.1, s) for k, s in shape.items()}
        m1, m2 = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        for step in range(1, EPOCHS + 1):
            z, t, g, a, n, m, f = self._forward(x, first)
            d = (1 / (1 + np.exp(-f)) - y) * weight
            dm = np.repeat(d, n)[:, None] * self.w["o"]
            da = (dm * z).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
            dt, dg = ds[:, None] * self.w["a"] * g * (1 - t * t), ds[:, None] * self.w["a"] * t * g * (1 - g)
            dz = (dm * a[:, None] + dt @ self.w["V"].T + dg @ self.w["U"].T) * (1 - z * z)
            grad = {"W": x.T @ dz, "b": dz.sum(0), "V": z.T @ dt, "U": z.T @ dg, "a": (t * g).T @ ds, "o": m.T @ d, "c": np.array([d.sum()])}
            for k in shape:
                gk = grad[k] + 1e-4 * self.w[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * gk, 0.999 * m2[k] + 0.001 * gk * gk
                self.w[k] = self.w[k] - 0.03 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        p = min(max(self.share, 1e-3), 1 - 1e-3)
        self.shift = float(np.log(p / (1 - p)))  # learned at equal shares
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.w is None or not len(first):
            return np.full(len(first), self.share)
        f = self._forward(((x - self.mean) / self.scale).clip(-6, 6), first)[-1] + self.shift
        return 1 / (1 + np.exp(-f))

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
                size += len(texts[end])
                end += 1
            out.append(np.round(self.score(*features(texts[at:end])), 9))  # sums' last bits depend on what is added up together
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL, held_out=None) -> Model:
    """Learn from a bounded sample of labelled rows; held_out(column name) says which ids are kept from it."""
    spark = docs.sparkSession
    small_batches(spark)
    out = held_out(id_col) if held_out else F.lit(False)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~out).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    if len(counts) < 2:
        return model
    order = [F.xxhash64(id_col), F.col(id_col)]
    sample = known.where("y = 0").orderBy(*order).limit(per_label).unionByName(known.where("y = 1").orderBy(*order).limit(per_label))
    kind = docs.schema[id_col].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [_spread(features([t])[0]).tobytes() for t in utf8(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(blobs, pa.binary()), b.column(2)], ["id", "x", "y"])

    # The sample's size is bounded by per_label, so it can be broadcast; what comes back by that and by SAMPLE_PASSAGES.
    seen = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).mapInArrow(vectors, f"id {kind}, x binary, y int")
    rows = sorted(seen.groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).collect(), key=lambda r: r["id"])
    if len({r["y"] for r in rows}) < 2:
        return model
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    first = np.cumsum([0, *(len(v) for v in xs[:-1])])
    return model.fit(np.concatenate(xs), first, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """id, held_out and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), pa.array(sent.value.score_texts(utf8(b.column(1))), pa.float64())], [id_col, score_col])

    return docs.select(id_col, text_col).mapInArrow(by_rows(run), f"`{id_col}` {kind}, `{score_col}` double")


def filtered(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(sent.value.score_texts(utf8(b.column(at))) >= 0.5))

    return docs.mapInArrow(by_rows(run), docs.schema)


def is_held_out(id_col: str):
    return remainder(id_col, 3) == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=is_held_out)
    scored = score(docs, model)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
