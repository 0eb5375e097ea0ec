"""Operator 3: near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is its set of distinct word shingles (64-bit hashes). Its sketch has T coordinates: in round i < T every
shingle is hashed to one bin of T, in round T + b to bin b, and a bin keeps its smallest value, round first; the second
half of the rounds guarantees that every coordinate fills, and estimates concentrate as with independent min-hashes.
Bands of R coordinates make keys; documents of a common key are candidates; similarity is then verified on full sets.

No pair is expanded within a group, and none is dropped:

1. Documents with equal sets share a class; one representative goes on.
2. In every bucket (band key) the smallest member is paired with each other member: as many pairs as rows.
3. Verified pairs are joined to components, by alternating large and small stars.
4. A bucket whose members then lie in several components can hide links between members that are not the smallest.
   Up to SQUARE members meet in one tile; where only up to SQUARE members are outside the bucket's largest component, those
   meet each part of it, so a bucket's rows are at most doubled; other buckets up to LARGE are cut into square tiles, so a
   row is copied LARGE / SQUARE times at most. In a tile, pairs of different components whose lengths and sketches allow the
   similarity (agreement within 6 standard deviations of it) are asked about in the first band that both sides share. The texts
   of a tile's members come to it once, and what is connected already isn't compared.
5. Beyond LARGE, documents that share boilerplate but aren't alike are not compared with each other but dealt anew, exactly:
   two sets at similarity s share one of the rarest n - ceil(s * n) + 1 shingles of either, rarest by any order that is the
   same for all. The order is by a bounded table of counts (CELLS), so shingles of boilerplate come last. Groups of a
   common rare shingle with several components are then tiles as in 4, and each pair is verified once.

With 32 bands of 5 a pair at similarity 0.8 shares no band with a probability of 3 in a million.

Texts travel to verification once for each pair, grouped by the pair's smaller side, whose set is made once; a hot one is
dealt over many tasks.

Cases: null and empty texts have no set, stay alone and are kept; with fewer words than a shingle has, the whole word
sequence is the one shingle; rows of equal id are one document, linked if any of its texts is (the output has one row
for each input row, with that row's set size); null ids stay alone with a null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, delete, kept, small_batches, table, utf8

#: Coordinates of a sketch, coordinates of a band.
T, R = 160, 5
#: Pairs of one left side that a task verifies, and the rows of one side of a square block.
DEALT, SQUARE = 64, 512
#: Counters of the table that tells rare shingles from frequent ones, a power of two.
CELLS = 1 << 22
#: Members of a bucket from which on, if many of them are outside its largest component, rare shingles deal it anew.
LARGE = 1 << 14
CACHE_WORDS = 400_000
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text in lower case (A-Z only)."""
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    if not len(h):
        return h
    out = h[:n].copy()
    for j in range(1, min(k, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX2 + np.uint64(min(k, len(h)))
    return np.unique(out ^ (out >> np.uint64(29)))


def sketch(s: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 1024 // len(s))
    bits = np.uint64(48)
    for at in range(0, 2 * T, step):
        rounds = np.arange(at, min(at + step, 2 * T), dtype=np.uint64)
        x = (s[None, :] + (rounds[:, None] + np.uint64(1)) * _MIX) * _MIX2
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x ^= x >> np.uint64(29)
        bins = ((x & np.uint64(0xFFFF)) * np.uint64(T)) >> np.uint64(16)
        fixed = rounds >= T
        if fixed.any():
            bins[fixed] = (rounds[fixed] - np.uint64(T))[:, None]
        value = (rounds[:, None] << bits) | (x >> np.uint64(16))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if (out >> bits).max() < at + len(rounds):
            break
    return out


def bands(c: np.ndarray) -> np.ndarray:
    """One signed key for each band of a sketch."""
    g = c.reshape(-1, R)
    x = np.arange(len(g), dtype=np.uint64) * _MIX2
    for j in range(R):
        x = ((x ^ (x >> np.uint64(31))) + g[:, j]) * _MIX
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n (set size), whole (a 128-bit hash of the set; null without words), coords (16 bits of each coordinate) and keys."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, whole, coords, keys = [], [], [], []
        for t in utf8(b.column(1)):
            s = shingles(t, k)
            n.append(len(s))
            if len(s):
                c = sketch(s)
                c = (c ^ (c >> np.uint64(16)) ^ (c >> np.uint64(48))).astype(np.uint16)
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                coords.append(c.tobytes())
                keys.append(bands(c.astype(np.uint64)))
            else:
                whole.append(None)
                coords.append(None)
                keys.append(None)
        return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(coords, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "whole", "coords", "keys"])

    return docs.mapInArrow(by_rows(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, whole binary, coords binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of different ids whose sets are similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A left side's pairs are dealt in parts of about DEALT by the other id; each part gets the left text once.
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("m") / DEALT)).cast("long")).alias("part"))
    lefts = dealt.select("a", "part").distinct()
    need = lefts.select("a", "part", F.col("a").alias("b")).unionByName(dealt)
    # The ids grow with the corpus: the same plan at every size, never a broadcast.
    rows = need.hint("merge").join(texts.select(F.col("id").alias("b"), "text"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, mine = None, []
        for batch in batches:
            out = []
            for a, part, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text"))):
                s = shingles((t or "").encode(), k)
                if a == b:
                    mine = [*mine, s] if left == (a, part) else [s]
                    left = (a, part)
                elif left == (a, part) and any(similar(x, s, percent) for x in mine):
                    out.append((a, b))
            if out:
                yield pa.record_batch([pa.array(c, batch.column("a").type) for c in zip(*out)], ["a", "b"])

    dealt_out = rows.select("a", "part", "b", "text").repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a"))
    return dealt_out.mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) for every end of an edge, by large and small stars until nothing changes."""
    spark = edges.sparkSession
    e, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new, new_path = kept(small, "edges")
        sums = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = e.agg(*sums).first() == new.agg(*sums).first()
        delete(spark, path)
        e, path = new, new_path
        if same:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _sized(rows: DataFrame) -> DataFrame:
    """rows of the groups with several components, with m (members), main (the largest component) and rest (members outside it). rows: key, component, ..."""
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return rows.join(per.select("key", "m", F.col("x.component").alias("main"), (F.col("m") - F.col("x.c")).alias("rest")), "key")


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of each group that lengths and sketches allow, by tiles: one row for each member
    of a tile that has such a pair, with the members it is to be compared with, most alike first. A pair belongs to the
    first band that its sides share. rows: band (-1: none), key, m, main, rest, id, n, component, coords."""
    kind = rows.schema["id"].dataType.simpleString()
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / SQUARE)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    is_main = F.col("component") == F.col("main")
    whole, split = F.col("m") <= SQUARE, F.col("rest") <= SQUARE
    # One tile; or parts of the main component (lo), each with all others (hi = -1); or squares of sides.
    mains = parts(F.col("m") - F.col("rest"))
    sides = parts(F.col("m"))
    of = lambda lo, hi, i: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), i.cast("int").alias("i"))
    zero, minus = F.lit(0), F.lit(-1)
    squares = F.transform(F.sequence(F.lit(0), sides - 1), lambda j: of(F.least(place(sides), j), F.greatest(place(sides), j), place(sides)))
    spread = F.when(is_main, F.array(of(place(mains), minus, zero))).otherwise(F.transform(F.sequence(F.lit(0), mains - 1), lambda j: of(j, minus, F.lit(1))))
    dealt = rows.withColumn("t", F.explode(F.when(whole, F.array(of(zero, zero, zero))).when(split, spread).otherwise(squares))).select("*", "t.lo", "t.hi", "t.i")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = percent / 100
    least = int(T * j - 6 * np.sqrt(T * j * (1 - j)))
    names = ["key", "lo", "hi", "id", "component", "others"]

    def compare(key: int, lo: int, hi: int, group: list[tuple]) -> list[tuple]:
        ids, n, comp, side = ([g[x] for g in group] for x in (0, 1, 2, 3))
        n, side = np.array(n), np.array(side)
        _, c, size = np.unique(np.array(comp), return_inverse=True, return_counts=True)
        if len(size) == 1:
            return []
        coords = np.stack([np.frombuffer(g[4], np.uint16) for g in group])
        band = group[0][5]
        place = np.lexsort((np.arange(len(group)), size[c]))  # members of small components ask, those of large ones are asked
        used, asks = np.zeros(len(group), bool), {}
        for at, x in enumerate(place[:-1].tolist()):
            y = place[at + 1 :]
            ok = (c[y] != c[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))
            if lo != hi and not (hi == -1 and lo == 0):  # pairs of one side belong to another tile
                ok &= side[y] != side[x]
            y = y[ok]
            if not len(y):
                continue
            same = coords[y] == coords[x]
            agree = same.sum(1)
            ok = agree >= least
            if band >= 0:
                ok &= same.reshape(len(y), -1, R).all(2).argmax(1) == band
            y, agree = y[ok], agree[ok]
            if len(y):
                used[x] = used[y] = True
                asks[x] = y[np.argsort(-agree, kind="stable")].tolist()
        return [(key, lo, hi, ids[x], comp[x], [ids[z] for z in asks.get(x, ())]) for x in np.flatnonzero(used).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, types = None, [], None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for b in batches:
            out = []
            t = b.column("id").type
            types = [pa.int64(), pa.int32(), pa.int32(), t, t, pa.list_(t)]
            for key, lo, hi, i, n, comp, side, c, band in zip(*(b.column(x).to_pylist() for x in ("key", "lo", "hi", "id", "n", "component", "i", "coords", "band"))):
                if (key, lo, hi) != at:
                    out += compare(*at, group) if len(group) > 1 else []
                    at, group = (key, lo, hi), []
                group.append((i, n, comp, side, c, band))
            if out:
                yield batch(out)
        if len(group) > 1 and (out := compare(*at, group)):
            yield batch(out)

    tiles = dealt.select("key", "lo", "hi", "id", "n", "component", "i", "coords", "band").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    return tiles.mapInArrow(run, f"key long, lo int, hi int, id {kind}, component {kind}, others array<{kind}>")


def _tile_links(tiles: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) of the tiles. Each text comes once to a tile; what is connected already isn't compared, so a tile gives fewer links than it has members."""
    kind = tiles.schema["id"].dataType.simpleString()
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles.hint("merge").join(texts, "id").select("key", "lo", "hi", "id", "component", "others", "text").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def links(group: list[tuple]) -> list[tuple]:
        sets: dict[object, list[set]] = {}
        for i, _, _, t in group:
            sets.setdefault(i, []).append(set(shingles((t or "").encode(), k).tolist()))
        root: dict = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        def alike(u: set, v: set) -> bool:
            both = len(u & v)
            return 100 * both >= percent * (len(u) + len(v) - both)

        comp = {i: ("c", c) for i, c, _, _ in group}
        out = []
        for i, _, others, _ in group:
            for o in others:
                x, y = find(comp[i]), find(comp[o])
                if x != y and any(alike(u, v) for u in sets[i] for v in sets[o]):
                    root[max(x, y)] = min(x, y)
                    out.append((min(i, o), max(i, o)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, t = None, [], None
        for b in batches:
            out, t = [], b.column("id").type
            for key, lo, hi, *row in zip(*(b.column(x).to_pylist() for x in ("key", "lo", "hi", "id", "component", "others", "text"))):
                if (key, lo, hi) != at:
                    out += links(group)
                    at, group = (key, lo, hi), []
                group.append(row)
            if out:
                yield pa.record_batch([pa.array(c, t) for c in zip(*out)], ["a", "b"])
        if group and (out := links(group)):
            yield pa.record_batch([pa.array(c, t) for c in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _rare_groups(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Groups of the members of large buckets by common rare shingles: key, id, component, and what `_sized` adds. members: id, component."""
    spark = members.sparkSession
    kind = members.schema["id"].dataType.simpleString()
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    mine, path = kept(members.hint("merge").join(texts, "id"), "large-buckets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [shingles(t, k) >> shift for t in utf8(b.column(0))]
            found, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.record_batch([pa.array(found.astype(np.int64)), pa.array(n)], ["cell", "n"])

    counted = mine.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    table_of = np.zeros(CELLS, np.int64)
    table_of[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    sent = spark.sparkContext.broadcast(table_of)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for b in batches:
            at, keys = [], []
            for i, t in enumerate(utf8(b.column(2))):
                s = shingles(t, k)
                first = len(s) - -(-percent * len(s) // 100) + 1
                s = s[np.lexsort((s, counts[(s >> shift).astype(np.int64)]))[:first]]
                at.append(np.full(len(s), i))
                keys.append(s)
            at = pa.array(np.concatenate(at))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(at), b.column(1).take(at)], ["key", "id", "component"])

    rows, rows_path = kept(mine.select("id", "component", "text").mapInArrow(rare, f"key long, id {kind}, component {kind}"), "rare-shingles")
    groups, _ = kept(_sized(rows), "rare-groups")
    delete(spark, path)
    delete(spark, rows_path)
    return groups


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig, sig_path = kept(signatures(texts, k), "signatures")
    # Classes of equal sets; the key has the smallest id.
    heads = sig.where("whole IS NOT NULL AND id IS NOT NULL").groupBy("whole").agg(F.min("id").alias("head"))
    classed = sig.select("id", "n", "whole").join(heads, "whole", "left")
    rep = sig.where("keys IS NOT NULL").join(heads.select(F.col("head").alias("id"), "whole"), ["id", "whole"], "left_semi").dropDuplicates(["id", "whole"])
    buckets, bucket_path = kept(rep.select("id", "n", F.posexplode("keys").alias("band", "key")), "buckets")
    sizes = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    full, full_path = kept(buckets.join(sizes, "key"), "full-buckets")
    delete(spark, bucket_path)
    one, one_path = kept(verified(full.where("id <> a").select("a", F.col("id").alias("b")).distinct(), texts, k, percent), "links")
    links, link_paths = one, [one_path]
    comp, _ = kept(components(links), "components")
    name = lambda df: df.drop("component").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows, rows_path = kept(_sized(name(full.select("band", "key", "id", "n"))), "mixed-buckets")
    many = (F.col("m") > LARGE) & (F.col("rest") > SQUARE)
    about = rep.select("id", "n", "coords")
    tiles, tile_path = kept(_tiles(rows.where(~many).join(about, ["id", "n"]), percent), "tiles")
    two, two_path = kept(_tile_links(tiles, texts, k, percent), "links")
    found, link_paths = [two], [*link_paths, two_path]
    large = rows.where(many).select("id", "component").distinct()
    if not large.isEmpty():
        groups = _rare_groups(large, texts, k, percent)
        rare = _tiles(groups.join(about, "id").withColumn("band", F.lit(-1)), percent)
        asked = rare.select("id", F.explode("others").alias("o")).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
        three, three_path = kept(verified(asked, texts, k, percent), "links")
        found, link_paths = [two, three], [*link_paths, three_path]
    delete(spark, tile_path)
    delete(spark, rows_path)
    new = [x for x in found if not x.isEmpty()]
    if new:
        for x in new:
            links = links.unionByName(x)
        comp, _ = kept(components(links), "components")
    for p in (full_path, *link_paths):
        delete(spark, p)
    out = classed.join(comp.select(F.col("id").alias("head"), "component"), "head", "left")
    final = F.coalesce("component", "head", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), final.alias("component_id"), F.coalesce(F.col("id") == final, F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op3_minhash": op3_minhash}
SQL: dict[str, str] = {}
