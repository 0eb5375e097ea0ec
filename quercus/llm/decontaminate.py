"""Operator 10: benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Words are compared case-folded, without ASCII punctuation. For each benchmark item, windows of the item's own length
slide over a document (a shorter document is one window). A window's 64-bit SimHash is made from its weighted five-word
shingles. Fingerprints are looked up in an index of eight 8-bit blocks: two fingerprints within RADIUS bits differ by at
most RADIUS // 8 in some block, so probing that ball in every block finds all of them. What lies within the radius is
verified by the exact weighted similarity: sums of weight * smaller count over sums of weight * larger count.

Two things are exact by construction. A window that shares no shingle with an item has similarity 0, so only windows
around shared shingles are fingerprinted, and looked up among the items that share one of the shingles there. And shingle
weights depend on the benchmark alone: the rarer among its items, the heavier. At a similarity of 0.8 a bit differs with a probability of 0.152, so a distance over 24 has one of about 1
in 1,000,000.

The benchmark is broadcast in parts of about PART_ITEMS items and PART_BYTES bytes, each part searched against all documents. Where
there are several, the counts of all items are made first, and all parts share those of shingles in two items or more (12
bytes each, of at most REPEATED; a benchmark with more is refused). A text of any length is searched as a whole, a bounded
number of windows and items at a time.

Cases: null and empty texts match nothing; an item of fewer than five words has its whole sequence as its one shingle;
items without words are ignored; items of equal text each match; of the windows of a document that match an item the
most similar, then the first, is returned; repeated rows of documents each have their own rows. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WORDS, PERCENT, RADIUS, BLOCKS = 5, 80, 24, 8
PART_ITEMS, PART_BYTES, CACHE_WORDS = 20_000, 32 << 20, 400_000
#: Shingles of several items that all parts share, at most.
REPEATED = 1 << 25
#: Windows times items that are looked up at once.
CELLS = 1 << 20
_TABLE = bytes(ord(" ") if chr(b) in string.punctuation else b for b in range(256))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BITS = np.arange(64, dtype=np.uint64)
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = text.casefold().encode().translate(_TABLE).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX2
    return out ^ (out >> np.uint64(29))


class Benchmark:
    """Items by shingle length and window length, their weights, and the Hamming index."""

    def __init__(self, rows: list[tuple[int, str]], total: int | None = None, repeated: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Of a part, total and repeated are the whole benchmark's: items, and shingles, sorted, of two items or more with their number."""
        hashed = [(i, h) for i, t in rows if len(h := word_hashes(t or ""))]
        self.items = [i for i, _ in hashed]
        self.length = np.array([len(h) for _, h in hashed], np.int64)
        self.k = np.minimum(self.length, WORDS)
        self.shingles = [shingles(h, int(k)) for (_, h), k in zip(hashed, self.k)]
        self.total = len(self.items) if total is None else total
        self.most = self._weight(1)
        self.repeated = None
        if repeated is None:
            df = Counter(x for s in self.shingles for x in set(s.tolist()))
            self.weight = {x: self._weight(n) for x, n in df.items()}
        else:
            each, back = np.unique(repeated[1], return_inverse=True)
            self.repeated = repeated[0], np.array([self._weight(int(n)) for n in each], np.int32)[back] if len(each) else np.zeros(0, np.int32)
            mine = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
            self.weight = dict(zip(mine.tolist(), self._shared(mine).tolist()))
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.by_k: dict[int, tuple] = {}
        for k in sorted(set(self.k.tolist())):
            mine = [j for j in range(len(self.items)) if self.k[j] == k]
            keys = np.unique(np.concatenate([self.shingles[j] for j in mine]))
            owners: list[dict[int, list[int]]] = [{} for _ in keys]  # of each shingle: window length -> places of its items among those of that length
            for n in sorted({int(self.length[j]) for j in mine}):
                for at, j in enumerate(x for x in mine if self.length[x] == n):
                    for p in np.searchsorted(keys, np.unique(self.shingles[j])).tolist():
                        owners[p].setdefault(n, []).append(at)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_k[k] = (keys, owners, np.array([self.weight[x] for x in keys.tolist()], np.int32), bitmap)
        self.by_length: dict[tuple[int, int], tuple] = {}
        for k, n in sorted({(int(a), int(b)) for a, b in zip(self.k, self.length)}):
            mine = np.array([j for j in range(len(self.items)) if self.k[j] == k and self.length[j] == n])
            prints = np.array([self.fingerprints(self.shingles[j], np.array([self.weight[x] for x in self.shingles[j].tolist()], np.int32), np.array([0]), np.array([len(self.shingles[j])]))[0] for j in mine], np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            near = _POPCOUNT[np.arange(256, dtype=np.uint8)[None, :, None] ^ blocks.T[:, None, :]] <= RADIUS // BLOCKS
            self.by_length[k, n] = (mine, blocks, near)

    def _weight(self, df: int) -> int:
        return 1 + round(4 * np.log2(1 + self.total / df))

    def _shared(self, s: np.ndarray) -> np.ndarray:
        """The weights of shingles by the whole benchmark's counts."""
        keys, weights = self.repeated
        out = np.full(len(s), self.most, np.int32)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            hit = keys[place] == s
            out[hit] = weights[place[hit]]
        return out

    @staticmethod
    def fingerprints(s: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """SimHashes of the windows s[start:end]."""
        signs = ((s[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
        sums = np.zeros((len(s) + 1, 64), np.int64)
        np.cumsum(signs * weights[:, None], 0, out=sums[1:])
        return ((sums[ends] - sums[starts] > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)

    def similarity(self, window: np.ndarray, item: int) -> tuple[int, int]:
        """The weighted sums of smaller and of larger counts."""
        mine, other = Counter(window.tolist()), self.counts[item]
        weights = self.weight if self.repeated is None else dict(zip(mine, self._shared(np.array(list(mine), np.uint64)).tolist()))
        both = sum(self.weight[x] * min(n, mine[x]) for x, n in other.items() if x in mine)
        total = sum(weights.get(x, self.most) * n for x, n in mine.items()) + sum(self.weight[x] * n for x, n in other.items())
        return both, total - both

    def matches(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item's index, similarity, first word, words) of each item that a document of these word hashes contains."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, (keys, owners, key_weights, bitmap) in self.by_k.items():
            s = shingles(h, k)
            at = np.flatnonzero(bitmap[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(at):
                continue
            place = np.searchsorted(keys, s[at])
            hit = keys[np.minimum(place, len(keys) - 1)] == s[at]
            at, place = at[hit], place[hit]
            if not len(at):
                continue
            by_n: dict[int, list[tuple[int, list[int]]]] = {}
            for p, o in zip(at.tolist(), place.tolist()):
                for n, sharing in owners[o].items():
                    by_n.setdefault(n, []).append((p, sharing))
            weights = np.full(len(s), self.most, np.int32) if self.repeated is None else self._shared(s)
            weights[at] = key_weights[place]
            for n, hits in by_n.items():
                self._slide(s, weights, k, n, hits, best)
        return [(j, *v) for j, v in sorted(best.items())]

    def _slide(self, s: np.ndarray, weights: np.ndarray, k: int, n: int, hits: list[tuple[int, list[int]]], best: dict) -> None:
        size = min(n - k + 1, len(s))  # shingles in a window
        last = len(s) - size
        mine, blocks, near = self.by_length[k, n]
        i = 0
        while i < len(hits):  # hits whose windows overlap, a bounded number of shingles at a time
            a, b = max(0, hits[i][0] - size + 1), min(hits[i][0], last)
            sharing = set(hits[i][1])
            i += 1
            while i < len(hits) and hits[i][0] - size + 1 <= b + 1 and b - a < 4096:
                b = min(hits[i][0], last)
                sharing.update(hits[i][1])
                i += 1
            if b < a:
                continue
            starts = np.arange(a, b + 1)
            prints = self.fingerprints(s[a : b + size], weights[a : b + size], starts - a, starts - a + size).view(np.uint8).reshape(-1, BLOCKS)
            asked = np.array(sorted(sharing))
            step = max(1, CELLS // len(starts))
            for c in range(0, len(asked), step):
                self._look_up(s, size, size + k - 1, starts, prints, asked[c : c + step], mine, blocks, near, best)

    def _look_up(self, s: np.ndarray, size: int, words: int, starts: np.ndarray, prints: np.ndarray, asked: np.ndarray, mine: np.ndarray, blocks: np.ndarray, near: np.ndarray, best: dict) -> None:
        """Windows and items that some block of the index brings together, by distance, then by exact similarity."""
        found = np.zeros((len(starts), len(asked)), bool)
        for block in range(BLOCKS):
            found |= near[block][:, asked][prints[:, block]]
        w, x = np.nonzero(found)
        x = asked[x]
        ok = _POPCOUNT[prints[w] ^ blocks[x]].sum(1) <= RADIUS
        for start, j in zip(starts[w[ok]].tolist(), mine[x[ok]].tolist()):
            both, either = self.similarity(s[start : start + size], j)
            if 100 * both >= PERCENT * either:
                sim = both / either
                if j not in best or (-sim, start) < (-best[j][0], best[j][1]):
                    best[j] = (sim, start, words)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_items: int = PART_ITEMS) -> DataFrame:
    """One row for each document and item that it contains: id, item, similarity, first_word, n_words."""
    small_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, similarity double, first_word long, n_words long"
    out = None
    for sent in _parts(benchmark, item_col, item_text_col, part_items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for b in batches:
                found = []
                ids = b.column(0)
                for at, t in enumerate(b.column(1).to_pylist()):
                    found += [(at, bench.items[j], sim, start, n) for j, sim, start, n in bench.matches(word_hashes(t or ""))]
                if found:
                    c = list(zip(*found))
                    yield pa.record_batch([ids.take(pa.array(c[0])), pa.array(c[1]), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], [id_col, item_col, "similarity", "first_word", "n_words"])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_items: int) -> Iterator:
    """The query set, broadcast in blocks of a checked size that all weigh shingles by the whole set."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    parts = max(1, -(-size["n"] // part_items), -(-(size["b"] or 0) // PART_BYTES))
    total, repeated = _counts(items) if parts > 1 else (None, None)
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        rows = [(r["i"], r["t"] or "") for r in part.collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark(rows, total, repeated))


def _counts(items: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The items that have words, and the shingles of two of them or more, sorted, with their number."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[int | None] = []
            for t in b.column(0).to_pylist():
                if len(h := word_hashes(t or "")):
                    found += [None, *np.unique(shingles(h, min(len(h), WORDS))).view(np.int64).tolist()]  # null: the item itself
            yield pa.record_batch([pa.array(found, pa.int64())], ["s"])

    n = items.select("t").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("s IS NULL OR n > 1").limit(REPEATED + 1).toArrow()
    if len(n) > REPEATED:
        raise ValueError(f"more than {REPEATED} shingles stand in several items of the benchmark")
    of_items = n.filter(pa.compute.is_null(n["s"]))["n"].to_pylist()
    n = n.filter(pa.compute.is_valid(n["s"]))
    keys = n["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return (of_items[0] if of_items else 0), (keys[order], n["n"].to_numpy()[order].astype(np.int32))


def without(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_items: int = PART_ITEMS) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    for sent in _parts(benchmark, item_col, item_text_col, part_items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not sent.value.matches(word_hashes(t or "")) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {}
