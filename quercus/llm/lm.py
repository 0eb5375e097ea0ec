"""Operator 7: language-model scores by a weighted backoff automaton.

The n-gram model is P(w | h) = (c(hw) + K * P(w | h')) / (c(h) + K), h' being h without its first word, down to the
smoothed unigrams (c + 0.5) / (N + 0.5 * (V + 1)). As an automaton: a state for each history that was seen, an arc with
its log-probability for each n-gram that was seen, and a failure arc to the shorter history with log10(K / (c(h) + K)).
One traversal from left to right carries the state and adds up weights (`Machine`).

At scale the automaton is never in one place. A block of some million tokens makes the sorted set of its own n-grams and
asks for their counts: keys go out packed by ranges of their hash, one row for each range and block; each range adds up
the training counts of all blocks and answers each block in its own order; the block then holds just the part of the
automaton that its texts can reach, and traverses it: the texts of the block side by side, a token each at a time. So every
n-gram crosses the network once for each block that has it, not once for each occurrence, frequent ones cannot make a hot
key, and what is gathered grows with the corpus.

The number of ranges follows the input's bytes, so a range stays at about RANGE_BYTES of input; ranges that a block has
nothing in make no row, so rows never outnumber n-grams. Answers are stored in one folder for each split of the input, not
for each block.

Both passes must see the same blocks: the input is a table or row-wise functions of one, the number of its splits is
pinned, and a checksum of every row of keys is compared, so a changed input fails instead of scoring wrongly.

Cases: null and empty texts are the end token alone; a text of any length is scored as a whole, in a block of its own if it
is longer than one; a null id is a training row; equal texts and repeated rows get equal scores; without training rows N = V =
0 and every probability is 1; an empty table gives no rows; columns other than id and text are ignored, whatever their names.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_folder, delete, kept, pin_splits, remainder, small_batches, table, utf8

#: Order of the model and K, the weight of the shorter history.
ORDER, K = 2, 40.0
#: Tokens after which a block is closed, at the end of a text.
BLOCK_TOKENS = 2_000_000
#: Bytes of texts for each range of hashes.
RANGE_BYTES = 16 << 20
#: Ranges that a task answers, at most on average.
RANGES_A_TASK = 8
#: Texts of a block that are still unread from which on each goes on by itself.
FEW = 12
#: Distinct words whose hashes a worker remembers.
CACHE_WORDS = 400_000
END, START = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = max(3, xxhash.xxh64_intdigest(word))
        return h


_hashes = _Hashes()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words in lower case (A-Z only), then the end token."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class Block:
    """The texts of a block: n-gram keys by order, each as sorted keys and each token's place in them."""

    def __init__(self, parts: list[np.ndarray], train: list[bool], order: int) -> None:
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts)
        self.first = np.cumsum(self.lengths) - self.lengths
        in_training = np.repeat(np.array(train, bool), self.lengths)
        self.keys, self.place, self.counts = [], [], []
        key, before = flat, flat
        for k in range(order):
            if k:  # the token before, START in front of the first
                before = np.append(np.uint64(START), before[:-1])
                before[self.first] = START
                key = _mixed(before, key)
            keys, place = np.unique(key, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place.astype(np.int32))
            self.counts.append(np.bincount(place[in_training], minlength=len(keys)).astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, list, Block]]:
    """(block's number, ids with held-out marks, block), the same for the same input. A block ends with the text that fills it."""
    parts: list[np.ndarray] = []
    train: list[bool] = []
    ids: list = []
    size, n = 0, 0
    top = TaskContext.get().partitionId() << 24
    for b in batches:
        held = b.column(2).to_pylist()
        since = 0
        for i, text in enumerate(utf8(b.column(1))):
            parts.append(tokens(text))
            train.append(not held[i])
            size += len(parts[-1])
            if size >= BLOCK_TOKENS:
                ids.append((b.column(0).slice(since, i + 1 - since), b.column(2).slice(since, i + 1 - since)))
                yield top + n, ids, Block(parts, train, order)
                parts, train, ids, size, n, since = [], [], [], 0, n + 1, i + 1
        if since < b.num_rows:
            ids.append((b.column(0).slice(since), b.column(2).slice(since)))
    if parts:
        yield top + n, ids, Block(parts, train, order)


def _by_range(block: Block, bits: int) -> Iterator[tuple[int, list[slice]]]:
    """(range, its part of the keys of each order) for the ranges, by the keys' first bits, that the block has something in."""
    of = [k >> np.uint64(64 - bits) for k in block.keys]
    there = np.unique(np.concatenate([x[np.append(True, x[1:] != x[:-1])] for x in of]))
    cuts = [(np.searchsorted(x, there, side="left").tolist(), np.searchsorted(x, there, side="right").tolist()) for x in of]
    for i, r in enumerate(there.tolist()):
        yield r, [slice(a[i], e[i]) for a, e in cuts]


def _sum_of(keys: list[bytes]) -> str:
    h = xxhash.xxh64()
    for k in keys:
        h.update(k)
    return h.hexdigest()


def counted(docs: DataFrame, order: int, bits: int) -> tuple[DataFrame, str, int, int]:
    """The answers (block, range, check, counts of each order), their folder, N and V."""
    names = [f"{x}{k}" for k in range(order) for x in ("keys", "counts")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches, order):
            rows = []
            for r, parts in _by_range(block, bits):
                row = [r]
                for k, part in enumerate(parts):
                    row += [block.keys[k][part].tobytes(), block.counts[k][part].astype(np.uint32).tobytes()]
                rows.append(row)
            for at in range(0, len(rows), 64):
                at_range, *columns = zip(*rows[at : at + 64])
                yield pa.record_batch([pa.array([number] * len(at_range), pa.int64()), pa.array(at_range, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["block", "range", *names])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            out = [[] for _ in range(order)]
            total = known = 0
            for k in range(order):
                keys = [np.frombuffer(r[f"keys{k}"], np.uint64) for r in rows]
                counts = np.concatenate([np.frombuffer(r[f"counts{k}"], np.uint32) for r in rows]).astype(np.float64)
                all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(place, counts, len(all_keys)).astype(np.int64)  # exact below 2 ** 53
                if k == 0:
                    total, known = int(sums.sum()), int((sums > 0).sum())
                found, at = sums[place], 0
                for x in keys:
                    out[k].append(found[at : at + len(x)].tobytes())
                    at += len(x)
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.record_batch(
                    [
                        pa.array([r["block"] for r in part], pa.int64()), pa.array([r["range"] for r in part], pa.int64()), pa.array([_sum_of([r[f"keys{k}"] for k in range(order)]) for r in part], pa.string()),
                        pa.array([total if at + i == 0 else 0 for i in range(len(part))], pa.int64()), pa.array([known if at + i == 0 else 0 for i in range(len(part))], pa.int64()),
                        *(pa.array(o[at : at + 64], pa.binary()) for o in out),
                    ],
                    ["block", "range", "check", "n", "v", *(f"counts{k}" for k in range(order))],
                )

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[-1]["range"] != r["range"]:
                    yield from of(held)
                    held = []
                held.append(r)
        if held:
            yield from of(held)

    asked = docs.mapInArrow(ask, "block long, range long, " + ", ".join(f"{n} binary" for n in names))
    # Tasks follow the ranges, and so the input's bytes.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // RANGES_A_TASK)
    schema = "block long, range long, check string, n long, v long, " + ", ".join(f"counts{k} binary" for k in range(order))
    answered = asked.repartition(n, "range").sortWithinPartitions("range", "block").mapInArrow(answer, schema)
    # One folder for each split of the input, of one file sorted by block, so that a task reads only the answers to its own blocks.
    flat, first = kept(answered, "lm-answers")
    stats = flat.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    by_split = flat.drop("n", "v").withColumn("split", F.shiftright("block", 24)).repartition(n, "split").sortWithinPartitions("split", "block", "range")
    by_block, path = kept(by_split, "lm-blocks", partition_by="split")
    delete(docs.sparkSession, first)
    return by_block, path, stats["n"] or 0, stats["v"] or 0


def _answers(path: str, number: int, block: Block, bits: int) -> list[np.ndarray]:
    """The counts of the block's keys, by order."""
    rows = sorted(by_folder(path, "split", number >> 24, filters=[("block", "=", number)]), key=lambda r: r["range"])
    mine = [(r, _sum_of([k[p].tobytes() for k, p in zip(block.keys, parts)])) for r, parts in _by_range(block, bits)]
    if [(r["range"], r["check"]) for r in rows] != mine:
        raise RuntimeError("the texts of a block aren't those that were counted: the input changed between the two passes")
    return [np.concatenate([np.frombuffer(r[f"counts{k}"], np.int64) for r in rows]) for k in range(len(block.keys))]


class Machine:
    """The part of the automaton that a block's texts can reach, in arrays.

    A state of level j is a history of j words, numbered as the block's j-grams are (the last number: the start of a text); the
    root is level 0. An arc of level k, from a state of that level, is numbered as the block's (k + 1)-grams are; it exists if the
    model has seen them, at the root always. Its target is the longest history that ends with it.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, weight: float) -> None:
        self.top = len(counts) - 1
        c = counts[0]
        self.base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        self.known = c > 0
        starts = counts[0][0] if len(block.keys[0]) and block.keys[0][0] == END else 0  # training texts: what was seen after START
        self.arc, self.exists, self.fail, self.shorter, self.target = [self.base], [np.ones(len(c), bool)], [np.zeros(1)], [np.zeros(1, np.int32)], []
        for k in range(1, self.top + 1):
            seen = np.append(counts[k - 1], starts)  # of the states of level k
            self.fail.append(np.log10(weight / (seen + weight)))
            self.shorter.append(np.append(self._of(block.place[k - 1], block.place[k - 2], len(counts[k - 1])), len(counts[k - 2])) if k > 1 else np.zeros(len(seen), np.int32))
            before = np.append(np.int32(0), block.place[k - 1][:-1])
            before[block.first] = len(counts[k - 1])
            history = seen[self._of(block.place[k], before, len(counts[k]))]
            back = self.arc[k - 1][self._of(block.place[k], block.place[k - 1], len(counts[k]))]
            self.exists.append(counts[k] > 0)
            self.arc.append(np.log10((counts[k] + weight * 10.0**back) / (history + weight)))
        for k in range(self.top + 1):  # (level, state) after each arc
            self.target.append(np.arange(len(counts[k]), dtype=np.int32) if k < self.top else self._of(block.place[k], block.place[k - 1], len(counts[k])) if k else np.zeros(len(counts[0]), np.int32))
        self.start = len(counts[self.top - 1]) if self.top else 0

    @staticmethod
    def _of(place: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        """What stands beside each key, the same wherever the key occurs."""
        out = np.zeros(n, np.int32)
        out[place] = other
        return out

    def scores(self, block: Block) -> np.ndarray:
        """The weight of each text's path: all texts step by step, the few longest by themselves."""
        order = np.argsort(-block.lengths, kind="stable")
        longest = block.lengths[order]
        first = block.first[order]
        level, state, total = np.full(len(order), self.top, np.int8), np.full(len(order), self.start, np.int32), np.zeros(len(order))
        t, live = 0, len(order)
        while live > FEW:
            at = first[:live] + t
            k, q, add = level[:live], state[:live], total[:live]
            for j in range(self.top, 0, -1):
                lost = np.flatnonzero((k == j) & ~self.exists[j][block.place[j][at]])
                add[lost] += self.fail[j][q[lost]]
                q[lost] = self.shorter[j][q[lost]]
                k[lost] = j - 1
            for j in range(self.top + 1):
                goes = np.flatnonzero(k == j) if self.top else np.arange(live)
                arcs = block.place[j][at[goes]]
                add[goes] += self.arc[j][arcs]
                q[goes] = self.target[j][arcs]
            np.minimum(k + 1, self.top, out=k)
            t += 1
            live = int(np.searchsorted(-longest, -t, side="left"))  # texts of more than t tokens
        for i in range(live):
            total[i] = self._walk(block, int(first[i]) + t, int(first[i] + longest[i]), int(level[i]), int(state[i]), float(total[i]))
        out = np.zeros(len(order))
        out[order] = total
        return out

    def _walk(self, block: Block, at: int, end: int, level: int, state: int, total: float) -> float:
        top, place, arc, exists, fail, shorter, target = self.top, block.place, self.arc, self.exists, self.fail, self.shorter, self.target
        for i in range(at, end):
            while not exists[level][place[level][i]]:
                total += fail[level][state]
                state = shorter[level][state]
                level -= 1
            a = place[level][i]
            total += arc[level][a]
            state = target[level][a]
            level = min(level + 1, top)
        return float(total)


def traverse(block: Block, counts: list[np.ndarray], n: int, v: int, weight: float) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base and score of each text of a block."""
    machine = Machine(block, counts, n, v, weight)
    per = lambda x: np.add.reduceat(x[block.place[0]], block.first)
    return block.lengths, per(machine.known.astype(np.int64)), per(machine.base), machine.scores(block)


def score(docs: DataFrame, held_out: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, weight: float = K) -> DataFrame:
    """Learn from the rows that aren't held out and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    pin_splits(spark)
    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)).bit_length()
    _, path, n, v = counted(rows, order, bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, block in _blocks(batches, order):
            columns = traverse(block, _answers(path, number, block, bits), n, v, weight)
            at = 0
            for i, held in ids:
                part = [pa.array(c[at : at + len(i)], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.record_batch([i, held, part[0], part[1], pa.array([n] * len(i), pa.int64()), *part[2:]], names)
                at += len(i)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Automaton:
    """The whole machine in plain dictionaries, for a model that fits in memory: what `Machine` is held against."""

    def __init__(self, texts: list[bytes], order: int = ORDER, weight: float = K) -> None:
        count: dict[tuple, int] = {}
        history: dict[tuple, int] = {}
        for t in texts:
            seq = [*t.lower().split(), None]
            for i, w in enumerate(seq):
                for k in range(order):
                    h = tuple(seq[j] if j >= 0 else START for j in range(i - k, i))
                    count[(*h, w)] = count.get((*h, w), 0) + 1
                    history[h] = history.get(h, 0) + 1
        self.order, n, v = order, history.get((), 0), sum(len(g) == 1 for g in count)
        self.unknown = np.log10(0.5 / (n + 0.5 * (v + 1)))
        self.arcs: dict[tuple, dict] = {}
        self.fail: dict[tuple, float] = {h: float(np.log10(weight / (c + weight))) for h, c in history.items() if h}
        for g in sorted(count, key=len):
            h, w = g[:-1], g[-1]
            p = (count[g] + 0.5) / (n + 0.5 * (v + 1)) if not h else (count[g] + weight * 10 ** self.arcs[h[1:]][w]) / (history[h] + weight)
            self.arcs.setdefault(h, {})[w] = float(np.log10(p))

    def score(self, text: bytes) -> float:
        state: tuple = (START,) * (self.order - 1)
        total = 0.0
        for w in [*text.lower().split(), None]:
            h = state
            while h and w not in self.arcs.get(h, {}):
                total += self.fail.get(h, 0.0)
                h = h[1:]
            total += self.arcs.get(h, {}).get(w, self.unknown)
            state = ((*state, w))[-(self.order - 1) :] if self.order > 1 else ()
        return total


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), lambda c: remainder(c, 5) == 1)


QUERIES = {"op7_lm": op7_lm}
SQL: dict[str, str] = {}
