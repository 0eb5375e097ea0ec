"""Operator 6: byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Text is split into pre-tokens; each is encoded by the merge list. From the merge list alone `lookahead()` computes a
number of bytes L such that text to the right can never change a token that ends L or more bytes before the end of what
has been read. The transducer therefore holds a window of a few L bytes, emits every token once it is stable and forgets
it: memory is constant however long a pre-token or a text is. Decoding feeds token bytes to a UTF-8 state machine that gives
out characters as they become complete; ids and decoded text go into running digests, never into a whole list. All texts take
this way (`transduce`).

Why L suffices. Apply the merges in order to a string w and to a longer string wx, and let d be the leftmost place from
which the two can differ; at first d = |w|. Only a merge (u, v) across d moves it, to d - |u|. The token that starts at
the new d is u or an extension of u, so the next merge (u', v') across it comes later in the list and its v' begins with
u. L is the largest sum of |u| over such chains. And any run of tokens of an encoding is the encoding of its own text, so
the window can start anew at a token's end.

Cases: null is the empty text: no tokens, the digests of the empty string. The special tokens of the file are found in
the text as the tokenizers library finds them. Equal rows give equal results; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, small_batches, table

#: The classes of the byte-level pre-tokenizer. White space is Unicode's White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
#: Below U+0100 the classes are these, so that `re` can be used, with bit maps.
LETTER_LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
NUMBER_LATIN = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPACE_LATIN = "\\t-\\r \\x85\\xa0"
OTHER_LATIN = "\\x00-\\x08\\x0e-\\x1f!-/:-@\\[-`{-\\x84\\x86-\\x9f\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf\\xd7\\xf7"
#: Distinct pre-tokens whose encoding a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: Characters that the transducer takes at once.
CHUNK = 1 << 16
#: Characters of chunks whose new pre-tokens are encoded together.
SLICE_CHARS = 2_000_000
_NO_RANK = 1 << 60


def _pattern(letter: str, number: str, other: str, space: str) -> str:
    return f" ?[{letter}]+|{CONTRACTIONS}| ?[{number}]+| ?[{other}]+|[{space}]+(?![{letter}{number}{other}])|[{space}]+"


LATIN = re.compile(_pattern(LETTER_LATIN, NUMBER_LATIN, OTHER_LATIN, SPACE_LATIN))
FULL = regex.compile(_pattern("\\p{L}", "\\p{N}", f"^{SPACE}\\p{{L}}\\p{{N}}", SPACE).replace(f"(?![\\p{{L}}\\p{{N}}^{SPACE}\\p{{L}}\\p{{N}}])", f"(?![^{SPACE}])"))
#: What can go on at the end of a chunk, by the class of the run.
RUNS = [regex.compile(x) for x in ("[\\p{L}]+", "[\\p{N}]+", f"[^{SPACE}\\p{{L}}\\p{{N}}]+", f"[{SPACE}]+")]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a whole text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return FULL.findall(text)
    return LATIN.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A merge list with its encoder and decoder."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        of = byte_alphabet()
        vocab = j["model"]["vocab"]
        raw = {t: bytes(of[c] for c in t) for t in vocab}
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.token_bytes = {i: raw[t] for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = [0] * 256  # the token of each single byte
        for t, b in raw.items():
            if len(b) == 1:
                self.first[b[0]] = vocab[t]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        #: (left, right) -> (rank, merged)
        self.merge = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.lookahead = lookahead([(raw[a], raw[b]) for a, b in merges])
        self.window = max(64, 4 * self.lookahead)
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.text_of = {str(i): b for i, b in self.token_bytes.items()}
        self.id_text = [str(i) for i in range(max(self.token_bytes) + 1)]
        self.pairs = _Pairs(self.merge)
        self.cache = _Words(self)
        self.group_bytes = _Groups(self.text_of)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of one pre-token that is held as a whole."""
        first, merge = self.first, self.merge
        ids = [first[b] for b in data]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, none = merge.get, (1 << 60, 0)
        while len(ids) > 1:
            best = min([get(p, none) for p in zip(ids, ids[1:])])
            if best is none:
                break
            rank, new = best
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and get((ids[i], ids[i + 1]), none)[0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n."""
        n, get = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            k = after[i] if alive[i] else n
            if k >= n or ids[i] != a or ids[k] != b:
                continue
            ids[i] = get((a, b))[1]
            alive[k] = False
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [t for t, live in zip(ids, alive) if live]

    def merged_many(self, windows: list[bytes]) -> list[list[int]]:
        """The tokens of many short pre-tokens at once: each round applies every window's best merge."""
        lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        ids = np.array(self.first, np.int64)[np.frombuffer(b"".join(windows), np.uint8)]
        ends = np.cumsum(lengths)
        of = np.repeat(np.arange(len(windows)), lengths)
        out: list = [None] * len(windows)
        while len(ids):
            rank, new = self.pairs.find(ids[:-1], ids[1:])
            rank = np.append(np.where(of[1:] == of[:-1], rank, _NO_RANK), _NO_RANK)
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(of)))
            best = np.minimum.reduceat(rank, starts)
            over = best == _NO_RANK
            if over.any():
                flat = ids.tolist()
                for w, a, n in zip(of[starts[over]].tolist(), starts[over].tolist(), sizes[over].tolist()):
                    out[w] = flat[a : a + n]
                live = np.repeat(~over, sizes)
                ids, of, rank, new = ids[live], of[live], rank[live], np.append(new, 0)[live]
                best, sizes = best[~over], sizes[~over]
                if not len(ids):
                    break
            else:
                new = np.append(new, 0)
            chosen = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(chosen) > 1:  # in a run of places side by side every second one merges, from the left
                fresh = np.append(True, np.diff(chosen) != 1)
                run_at = np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(chosen))))
                chosen = chosen[(np.arange(len(chosen)) - run_at) % 2 == 0]
            ids[chosen] = new[chosen]
            stay = np.ones(len(ids), bool)
            stay[chosen + 1] = False
            ids, of = ids[stay], of[stay]
        return [x or [] for x in out]

    def encode_text(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        out: list[str] = []
        transduce(self, [text], lambda _, groups: out.extend(groups))
        return ",".join(out)

    def decode_bytes(self, groups: list[str]) -> bytes:
        """The bytes of ids that come in groups; short groups are remembered."""
        return b"".join(map(self.group_bytes.__getitem__, groups))


def _segments(bpe: Bpe, text: str) -> Iterator[tuple[str | None, str, bool]]:
    """(special token's id or None, characters, whether the transducer ends with them): the text in chunks."""
    at = 0
    for m in bpe.split_special.finditer(text) if bpe.split_special else ():
        for i in range(at, m.start(), CHUNK):
            yield None, text[i : min(i + CHUNK, m.start())], i + CHUNK >= m.start()
        yield str(bpe.special[m[0]]), "", True
        at = m.end()
    for i in range(at, len(text), CHUNK):
        yield None, text[i : i + CHUNK], i + CHUNK >= len(text)


def transduce(bpe: Bpe, texts: list[str], emit: Callable[[int, list[str]], None]) -> None:
    """Encode every text by a transducer of its own; emit(text's place, groups of ids) gets the tokens once they are stable.

    The texts go on side by side, a chunk each in a round, so that the new pre-tokens of a round are encoded together. What
    is held is a slice of at most SLICE_CHARS characters of chunks, and each transducer's unfinished end.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + min(CHUNK, len(texts[end])) <= SLICE_CHARS):
            size += min(CHUNK, len(texts[end]))
            end += 1
        live = [(i, Transducer(bpe), _segments(bpe, texts[i])) for i in range(at, end)]
        while live:
            steps, still = [], []
            for i, machine, chunks in live:
                if (step := next(chunks, None)) is not None:
                    special, chunk, last = step
                    steps.append((i, [special], []) if special else (i, *machine.split(chunk, last)))
                    still.append((i, machine, chunks))
            bpe.cache.learn(words for _, _, words in steps)
            for i, ready, words in steps:
                if groups := [*ready, *map(bpe.cache.__getitem__, words)]:
                    emit(i, groups)
            live = still
        at = end


class _Pairs:
    """The merges as an open hash table in arrays: rank and merged token of many pairs at once."""

    BITS = 20

    def __init__(self, merge: dict[tuple[int, int], tuple[int, int]]) -> None:
        bits = max(self.BITS, (4 * len(merge)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.new = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        keys = np.array([a << 24 | b for a, b in merge], np.int64)
        self.probes = 1
        for k, h, (r, t) in zip(keys.tolist(), self._hash(keys).tolist(), merge.values()):
            n = 1
            while self.key[h] >= 0:
                h, n = (h + 1) & self.mask, n + 1
            self.key[h], self.rank[h], self.new[h] = k, r, t
            self.probes = max(self.probes, n)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = a << 24 | b
        at = self._hash(keys)
        for _ in range(self.probes - 1):
            there = self.key[at]
            again = np.flatnonzero((there != keys) & (there >= 0))
            if not len(again):
                break
            at[again] = (at[again] + 1) & self.mask
        hit = self.key[at] == keys
        return np.where(hit, self.rank[at], _NO_RANK), self.new[at]


class _Words(dict):
    """Encodings of pre-tokens as joined ids, in two generations of at most CACHE_WORDS each."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.old: dict[str, str] = {}

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Encode together what is not yet known."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        words = set().union(*lists)
        known = [w for w in words if w in self.old and w not in self]
        self.update((w, self.old[w]) for w in known)
        new = [w for w in words if w not in self]
        data = [w.encode() for w in new]
        short = [i for i, x in enumerate(data) if len(x) <= CACHE_CHARS]
        if short:
            text = self.bpe.id_text
            for i, ids in zip(short, self.bpe.merged_many([data[i] for i in short])):
                self[new[i]] = ",".join([text[t] for t in ids])

    def __missing__(self, word: str) -> str:
        if len(self) > 2 * CACHE_WORDS:
            self.clear()
        data = word.encode()
        if len(data) <= self.bpe.window:
            out = ",".join(map(str, self.bpe.merged(data)))
        else:
            run = Run(self.bpe)
            out = ",".join(map(str, [*run.feed(data), *run.finish()]))
        if len(word) <= CACHE_CHARS:
            self[word] = out
        return out


class _Groups(dict):
    """Bytes of groups of ids, at most 2 * CACHE_WORDS short ones at a time."""

    def __init__(self, text_of: dict[str, bytes]) -> None:
        self.text_of = text_of

    def __missing__(self, group: str) -> bytes:
        out = b"".join(map(self.text_of.__getitem__, group.split(","))) if group else b""
        if len(group) <= 4 * CACHE_CHARS:
            if len(self) >= 2 * CACHE_WORDS:
                self.clear()
            self[group] = out
        return out


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which no token can change any more; see the head of this module."""
    best: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        reach = len(u) + max((best.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        best[u] = max(best.get(u, 0), reach)
        most = max(most, reach)
    return most


class Run:
    """One pre-token as a stream of bytes: a bounded window, tokens once they are stable."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held = bpe, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = self.bpe.window
        for i in range(0, len(data), step):
            self.held += data[i : i + step]
            if len(self.held) > step:
                end, stable = 0, len(self.held) - self.bpe.lookahead
                for t in self.bpe.merged(self.held):
                    if end + len(self.bpe.token_bytes[t]) > stable:
                        break
                    out.append(t)
                    end += len(self.bpe.token_bytes[t])
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out = self.bpe.merged(self.held)
        self.held = b""
        return out


class Transducer:
    """Text in chunks to pre-tokens that are over. Holds the last unfinished pre-token, or the window of one that outgrew CHUNK.

    A pre-token no longer than the window is one step of the transducer, whose output is the same wherever the pre-token
    stands and is therefore remembered; a longer one goes through `Run`, which emits its tokens once they are stable.
    """

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held, self.run, self.cls = bpe, "", None, None

    def split(self, chunk: str, last: bool) -> tuple[list[str], list[str]]:
        """(ids that are ready, pre-tokens that follow them) after one more chunk; after the last one nothing is held."""
        ready: list[str] = []
        text = self.held + chunk if self.held else chunk
        self.held = ""
        if self.run is not None:
            text = self._go_on(text, ready)
        if self.run is not None:
            if last:
                ready += map(str, [*self.run.feed(self.held.encode()), *self.run.finish()])
                self.held, self.run = "", None
            return ready, []
        words = pretokens(text)
        if last:
            return ready, words
        # The last pre-token may go on; one before it too, as white space gives its last character to what follows.
        back = 2 if len(words) > 1 else 1
        done, self.held = words[:-back], "".join(words[-back:])
        if len(self.held) >= CHUNK:
            ready += map(self.bpe.cache.__getitem__, done)
            done = []
            self._open(ready)
        return ready, done

    def _open(self, out: list[str]) -> None:
        """The held text is long: stream its last pre-token."""
        words = pretokens(self.held)
        if len(words) == 2 and len(words[-1]) < CHUNK:
            if words[0][-1].isspace() and words[-1].isspace():
                words = [self.held]
            else:  # the first is long but over
                out.append(self.bpe.cache[words[0]])
                self.held = words[1]
                return
        out += map(self.bpe.cache.__getitem__, words[:-1])
        last = words[-1]
        self.cls = next(k for k, c in enumerate(RUNS) if c.match(last, len(last) - 1))
        self.run = Run(self.bpe)
        self.held = ""
        self._put(last, out)

    def _put(self, part: str, out: list[str]) -> None:
        if self.cls == 3:  # white space: its last character may belong to the next pre-token
            part, self.held = part[:-1], part[-1]
        out += map(str, self.run.feed(part.encode()))

    def _go_on(self, text: str, out: list[str]) -> str:
        m = RUNS[self.cls].match(text)
        n = m.end() if m else 0
        if n == len(text):
            self._put(text, out)
            return ""
        if self.cls == 3 and n > 1:
            out += map(str, self.run.feed(text[: n - 1].encode()))
        elif self.cls != 3:
            out += map(str, self.run.feed(text[:n].encode()))
        out += map(str, self.run.finish())
        self.run = None
        return text[max(0, n - 1) :] if self.cls == 3 else text[n:]


class Sink:
    """What becomes of a text's tokens as they are emitted: their number, the ids, and the text decoded from them, or the digests of both."""

    def __init__(self, bpe: Bpe, keep: bool) -> None:
        self.bpe, self.keep, self.n = bpe, keep, 0
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.ids, self.text = ([], []) if keep else (hashlib.sha256(), hashlib.sha256())

    def add(self, groups: list[str]) -> None:
        joined = ",".join(groups)
        decoded = self.machine.decode(self.bpe.decode_bytes(groups))
        if self.keep:
            self.ids.append(joined)
            self.text.append(decoded)
        else:
            self.ids.update(("," + joined if self.n else joined).encode())
            self.text.update(decoded.encode())
        self.n += joined.count(",") + 1

    def finish(self) -> tuple[int, str, str]:
        rest = self.machine.decode(b"", final=True)
        if self.keep:
            return self.n, ",".join(self.ids), "".join([*self.text, rest])
        self.text.update(rest.encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


_loaded: dict[str, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """The tokenizer of this specification; a worker builds it once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def tokenizer_spec(path: str | None = None) -> str:
    """The vocabulary file's text; read on the driver and sent to the executors, as its size is that of a vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("a vocabulary file over 64 MB isn't sent to the executors")
    return spec


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_texts: bool = False) -> DataFrame:
    """Encode every text and decode it again: id, n_tokens, ids (joined) and decoded text, or their digests."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec.value)
        texts = [t or "" for t in b.column(1).to_pylist()]
        sinks = [Sink(bpe, keep_texts) for _ in texts]
        transduce(bpe, texts, lambda i, groups: sinks[i].add(groups))
        counts, ids, decoded = zip(*(x.finish() for x in sinks))
        return pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", names[0], names[1]])

    names = ("ids", "decoded") if keep_texts else ("ids_sha256", "decoded_sha256")
    return docs.select(id_col, text_col).mapInArrow(by_rows(run), f"`{id_col}` {kind}, n_tokens long, {names[0]} string, {names[1]} string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
