"""Operator 11: alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of the linked pairs.

A text is encoded by a byte-level BPE vocabulary (A) and by a piece vocabulary (B). Where tokens of both end at the same byte they
are linked, and such ends cut the text into groups. A linked pair is one packed int64: B's id in the upper half, A's in the
lower, so that a B id's pairs lie side by side in sorted order.

1. One pass encodes (`aligned`): per document the counts, the digest of its groups, its distinct pairs and how often it has them.
   The rows are stored; texts are read and encoded once.
2. `partial_counts` sums pairs per partition with np.unique; only these sums are shuffled.
3. `count_shards` sorts the sums globally by ranges of the key, adds up runs, and writes each range as two arrays (keys, counts) in
   the shared folder; it returns one row a shard, with the highest count of every B id in it.
4. `scored` looks the documents' pairs up: shards are memory-mapped where the shared folder can be, otherwise read one at a time,
   and searched by np.searchsorted. No document is shuffled.

Encodings of pre-tokens (A) and of words with the spaces before them (B) are remembered, in bounded tables. For B this is exact
because no piece has a space after another character, which is checked when the model is loaded; a model that has one
encodes whole texts.

Cases: null and empty texts, and texts whose joined tokens differ from space+text (such as those with U+2581, which stands for
a space in B), have no tokens: zeros and an empty digest column. Strings of special tokens are plain text. Equal rows give equal rows
and count each time. Texts of any length are encoded whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import file_system, kept, new_folder, small_batches, table

#: Bits of A's id in a packed pair.
HALF = 32
LOW = (1 << HALF) - 1
#: Distinct pairs that a task of partial counts holds before it gives them out.
HELD_PAIRS = 4_000_000
#: Words whose encoding a worker remembers, in each of two generations, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
WORD = re.compile(" +[^ ]*")


class _Memory(dict):
    """word -> its ids as packed int32, None if their bytes aren't the word's; at most two generations of CACHE_WORDS words."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]) -> None:
        self.encode_many, self.token_bytes, self.old = encode_many, token_bytes, {}

    def packed(self, word: bytes, ids: list[int]) -> bytes | None:
        return np.array(ids, np.int32).tobytes() if b"".join(map(self.token_bytes.__getitem__, ids)) == word else None

    def learn(self, words: Iterable[str]) -> dict[str, bytes | None]:
        """What is known of every distinct word; new ones are encoded together, long ones aren't remembered."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        out, new = {}, []
        for w in set(words):
            if w in self:
                out[w] = self[w]
            elif w in self.old:
                out[w] = self[w] = self.old[w]
            else:
                new.append(w)
        for w, ids in zip(new, self.encode_many(new) if new else ()):
            out[w] = self.packed(w.encode(), ids)
            if len(w) <= CACHE_CHARS:
                self[w] = out[w]
        return out


class Pair:
    """Both tokenizers: ids and byte lengths of a text's tokens."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece

        self.a = bpe.loaded(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_a = [self.a.token_bytes.get(i, b"") for i in range(max(self.a.token_bytes) + 1)]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.words_a, self.words_b = _Memory(self._merged, bytes_a), _Memory(self._pieces, bytes_b)
        #: Words can be encoded by themselves: spaces only begin pieces, and the model writes a space before each text and changes nothing else.
        probe = "a  b c   d "
        self.by_words = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i)) and self.b.encode(probe) == [t for w in self._pieces(WORD.findall(" " + probe)) for t in w]
        #: A token with what follows it in the written groups: the same group's next one, B's first, or the next group.
        self.written = [f"{i}{end}" for count, ends in ((len(bytes_a), ",|"), (len(bytes_b), ",;")) for end in ends for i in range(count)]

    def _merged(self, words: list[str]) -> list[list[int]]:
        data = [w.encode() for w in words]
        short = [i for i, x in enumerate(data) if len(x) <= CACHE_CHARS]
        known = dict(zip(short, self.a.merged_many([data[i] for i in short]))) if short else {}
        return [known[i] if i in known else self.a.merged(x) for i, x in enumerate(data)]

    def _pieces(self, words: list[str]) -> list[list[int]]:
        """B's ids of words that begin with a space, which the model itself puts before what it gets; of nothing it makes nothing."""
        found = self.b.encode([w[1:] for w in words], num_threads=1)
        return [ids if w != " " else [self.space] for w, ids in zip(words, found)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of every text that is not empty; two empty arrays where the joined tokens differ from space+text.

        New words of a slice of texts, of at most SLICE_CHARS characters or one text, are encoded together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= bpe.SLICE_CHARS):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            alone = [self.by_words and "▁" not in t for t in part]
            words_a = [bpe.pretokens(" " + t) for t in part]
            words_b = [WORD.findall(" " + t) if x else [] for t, x in zip(part, alone)]
            known_a, known_b = self.words_a.learn(chain(*words_a)), self.words_b.learn(chain(*words_b))
            for text, x, of_a, of_b in zip(part, alone, words_a, words_b):
                packed = [known_a[w] for w in of_a], [known_b[w] for w in of_b] if x else [self.words_b.packed((" " + text).encode(), self.b.encode(text))]
                if any(None in p for p in packed) or "".join(of_a) != " " + text or x and "".join(of_b) != " " + text:
                    packed = [], []
                yield tuple(np.frombuffer(b"".join(p), np.int32).astype(np.int64) for p in packed)
            at = end

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, str]:
        """The packed pairs of a text's links in order, and its groups as text. The last byte is an end of both, so every token is in a group."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.zeros(ends_a[-1] + 1, np.int8)
        ends[ends_a] += 1
        ends[ends_b] += 1
        both_a, both_b = ends[ends_a] == 2, ends[ends_b] == 2
        last_a, last_b = np.flatnonzero(both_a), np.flatnonzero(both_b)
        pairs = b[last_b] << HALF | a[last_a]
        # A's token goes before its group's tokens of B, B's after its group's tokens of A.
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        at_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
        at_b = np.arange(len(b)) + (last_a + 1)[group_b]
        n, m = len(self.len_a), len(self.len_b)
        which = np.empty(len(a) + len(b), np.int64)
        which[at_a], which[at_b] = a + n * both_a, b + 2 * n + m * both_b
        return pairs, "".join([self.written[i] for i in which.tolist()])[:-1]


_loaded: dict[str, Pair] = {}


def _pair(spec: str, model: bytes) -> Pair:
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pair(spec, model)
    return _loaded[key]


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError("a model file over 64 MB isn't sent to the executors")
    return model


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, the groups or their digest, distinct packed pairs (sorted) and their numbers."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((bpe.tokenizer_spec(path_a), _model(path_b)))
    kind = docs.schema[id_col].dataType.simpleString()
    name = "groups" if keep_groups else "groups_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = _pair(*sent.value)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, keys, times = [], [], []
            full = pair.encode([t for t in texts if t])
            for t in texts:
                a, b = next(full) if t else (np.empty(0, np.int64), np.empty(0, np.int64))
                if not len(a):
                    rows.append((0, 0, 0, 0, ""))
                    keys.append(a)
                    times.append(a)
                    continue
                pairs, written = pair.groups(a, b)
                rows.append((len(a), len(b), len(pairs), len(pairs), written if keep_groups else hashlib.sha256(written.encode()).hexdigest()))
                distinct, n = np.unique(pairs, return_counts=True)
                keys.append(distinct)
                times.append(n)
            cut = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (keys, times)]
            counts = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(counts[4], pa.string()), *lists], [id_col, "n_a", "n_b", "n_groups", "n_links", name, "pairs", "times"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, {name} string, pairs array<long>, times array<long>")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their sums."""
    distinct, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, n)
    return distinct, out


def partial_counts(rows: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """(pair, n): the sums of each partition's rows, given out whenever `held` distinct pairs are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*parts)))

        def out(sums: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(sums[0]), 1 << 16):
                yield pa.record_batch([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in sums], ["pair", "n"])

        for b in batches:
            parts.append((b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False)))
            size += len(parts[-1][0])
            if size > held:
                parts = [gathered()]
                size = len(parts[0][0])
                if size > held // 2:
                    yield from out(parts[0])
                    parts, size = [], 0
        if parts:
            yield from out(gathered())

    return rows.select("pairs", "times").mapInArrow(run, "pair long, n long")


def count_shards(partial: DataFrame, folder: str) -> list[dict]:
    """Sort the partial counts globally, add up runs, write arrays in `folder`. One dict a shard: name, n, first, last, and ids and best
    of B's tokens, whose sizes are bounded by the shards and B's vocabulary. A task that runs again writes files of other names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, n, first, last = uuid.uuid4().hex, 0, None, None
        best: dict[int, int] = {}
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        with fs.open_output_stream(f"{base}/{name}.keys") as keys, fs.open_output_stream(f"{base}/{name}.counts") as counts:

            def put(k: np.ndarray, c: np.ndarray) -> None:
                keys.write(k.tobytes())
                counts.write(c.tobytes())
                ids = k >> HALF
                starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                for i, x in zip(ids[starts].tolist(), np.maximum.reduceat(c, starts).tolist()):
                    best[i] = max(best.get(i, 0), x)

            for b in batches:
                if not b.num_rows:
                    continue
                k, c = _summed(np.append(held[0], b.column(0).to_numpy()), np.append(held[1], b.column(1).to_numpy()))
                first = int(k[0]) if first is None else first
                if len(k) > 1:  # the last run may go on
                    put(k[:-1], c[:-1])
                    n += len(k) - 1
                held = k[-1:], c[-1:]
            if len(held[0]):
                put(*held)
                n, last = n + 1, int(held[0][0])
        if n:
            yield pa.RecordBatch.from_pylist([{"name": name, "n": n, "first": first, "last": last, "ids": list(best), "best": list(best.values())}])

    rows = partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, "name string, n long, first long, last long, ids array<long>, best array<long>")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["first"])


class Shards:
    """The counts of sorted distinct pairs from the shards that hold them."""

    def __init__(self, folder: str, shards: list[tuple[str, int, int, int]]) -> None:
        self.fs, self.base = file_system(folder)
        self.shards, self.open = shards, {}

    def _array(self, name: str, n: int) -> np.ndarray:
        """Mapped where the folder is in a local or mounted file system; elsewhere read, the latest two being kept."""
        if name not in self.open:
            if self.fs.type_name == "local":
                self.open[name] = np.memmap(posixpath.join(self.base, name), np.int64, "r", shape=(n,))
            else:
                while len(self.open) > 2:
                    self.open.pop(next(iter(self.open)))
                with self.fs.open_input_file(posixpath.join(self.base, name)) as f:
                    self.open[name] = np.frombuffer(f.read(), np.int64)
        return self.open[name]

    def find(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for name, n, first, last in self.shards:
            i, j = np.searchsorted(pairs, first), np.searchsorted(pairs, last, side="right")
            if i < j:
                at = np.searchsorted(self._array(f"{name}.keys", n), pairs[i:j])
                out[i:j] = self._array(f"{name}.counts", n)[at]
        return out


def scored(rows: DataFrame, folder: str, shards: list[dict]) -> DataFrame:
    """The rows of `aligned` with n_best and count_sum in place of their pairs."""
    ids = np.array([i for s in shards for i in s["ids"]], np.int64)
    top = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    np.maximum.at(top, ids, np.array([x for s in shards for x in s["best"]], np.int64))
    sent = rows.sparkSession.sparkContext.broadcast(([(s["name"], s["n"], s["first"], s["last"]) for s in shards], top))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, best = sent.value
        counts = Shards(folder, files)
        for b in batches:
            pairs, times = (b.column(len(names) + i) for i in (0, 1))
            sizes = np.asarray(pairs.value_lengths().fill_null(0))
            keys, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, times))
            distinct, at = np.unique(keys, return_inverse=True)
            found = counts.find(distinct)
            is_best = (found == best[distinct >> HALF])[at] if len(distinct) else np.empty(0, bool)
            ends = np.cumsum(sizes)
            sums = [np.append(0, np.cumsum(x)) for x in (np.where(is_best, n, 0), found[at] * n)]
            per_row = [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
            yield pa.record_batch([*(b.column(i) for i in range(len(names))), *per_row], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "pairs", "times").mapInArrow(run, f"{schema}, n_best long, count_sum long")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Every document's counts, groups (or their digest), n_best and count_sum."""
    spark = docs.sparkSession
    rows, _ = kept(aligned(docs, id_col, text_col, path_a, path_b, keep_groups), "aligned")
    partial, _ = kept(partial_counts(rows), "pair-sums")
    folder = new_folder(spark, "pair-counts")
    return scored(rows, folder, count_shards(partial, folder))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_align": op11_align}
SQL: dict[str, str] = {}
