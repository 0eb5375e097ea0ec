"""Operator 13: exact Lloyd clustering of integer vectors by a dual-tree traversal.

Vectors are turned into integers and stored once, in blocks of at most BLOCK rows; each block holds its vectors, a cover tree over
them (a node's children are a power of two apart and cover its vectors within that radius) and, for every node, the number and the
sum of its vectors. A round sends the centroids to the tasks; each task builds a cover tree over the centroids and descends both
trees together. A pair of nodes goes when even its nearest members are farther apart than the vectors' node is from some centroid; where one
centroid is left the whole node is its own, with the stored sum, and no vector is looked at. What is left at leaves is compared exactly in
integers. Bounds are widened by more than the rounding of floating point, so they never decide a tie. A task gives out one count and one sum
a centroid; Spark adds them up, and only the k sums reach the driver, which divides them exactly.

Cases: only vectors with exactly `dim` components, all of them present and finite, are kept. Components beyond LARGEST after scaling can't have
squared distances in 64 bits and are an error. Repeated rows and equal vectors count each; a null id is a vector like others, whose
hash is that of the prefix and "null"; among equal hashes the smaller vector starts. With fewer than k vectors there are as many centroids as
vectors. Of equally near centroids the smaller number wins. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

#: Rows of a block, and of a leaf of its tree.
BLOCK, LEAF = 1024, 16
LARGEST = 1 << 27
#: Share by which bounds are widened; distances are sums of up to a few hundred squares in double precision.
SLACK = 1e-9


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """(id, v): the kept vectors as arrays of long, floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = F.transform(v, lambda x: F.when(F.abs(x) * scale <= LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST} after scaling")).cast("long")))
    return vectors.where((F.size(v) == dim) & ~F.exists(v, odd)).select(F.col(id_col), scaled.alias("v"))


def first_centroids(kept_vectors: DataFrame, k: int = 8, prefix: str = "3:") -> np.ndarray:
    """The k vectors with the smallest hashes, in that order."""
    name = kept_vectors.columns[0]
    text = F.concat(F.lit(prefix), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    rows = kept_vectors.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Tree:
    """A cover tree in arrays: vectors in the tree's order, and for each node its centre's place, radius, span of vectors and next sibling.

    Nodes are in the order of descent, so a node's first child follows it. A centre is the first vector of its span."""

    def __init__(self, order: np.ndarray, start: np.ndarray, end: np.ndarray, after: np.ndarray, radius: np.ndarray) -> None:
        self.order, self.start, self.end, self.after, self.radius = order, start, end, after, radius

    @classmethod
    def of(cls, v: np.ndarray, leaf: int = LEAF) -> Tree:
        x = v.astype(np.float64)
        order: list[int] = []
        start, end, after, radius = [], [], [], []

        def away(rows: np.ndarray, i: int) -> np.ndarray:
            d = x[rows] - x[i]
            return np.sqrt(np.einsum("ij,ij->i", d, d))

        def add(centre: int, rest: np.ndarray, far: np.ndarray) -> None:
            """A node of a centre and the others in its reach, whose distances are `far`."""
            node = len(start)
            start.append(len(order))
            radius.append(float(far.max()) if len(far) else 0.0)
            end.append(len(order) + 1 + len(rest))
            after.append(0)
            if len(rest) < leaf or radius[node] == 0:
                order.extend([centre, *rest.tolist()])
            else:
                reach = 2.0 ** (math.ceil(math.log2(radius[node])) - 1)  # the level below: every vector is within it of a child's centre
                near = far <= reach
                add(centre, rest[near], far[near])
                rest = rest[~near]
                while len(rest):
                    d = away(rest, rest[0])
                    near = d <= reach
                    near[0] = False
                    first, mine, dist = int(rest[0]), rest[near], d[near]
                    near[0] = True
                    rest = rest[~near]
                    add(first, mine, dist)
            after[node] = len(start)

        if len(x):
            rest = np.arange(1, len(x))
            add(0, rest, away(rest, 0))
        return cls(np.array(order, np.int64), *(np.array(a, np.int64) for a in (start, end, after)), np.array(radius))

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < self.after[node]:
            out.append(at)
            at = int(self.after[at])
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all of b."""
    out = np.empty((len(a), len(b)), np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Descent:
    """The centroids with their tree, set against blocks."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c, self.x = centroids, centroids.astype(np.float64)
        self.tree = Tree.of(centroids, leaf=1)
        self.below = [self.tree.children(i) for i in range(len(self.tree.start))]

    def nearest(self, tree: Tree, v: np.ndarray, owned) -> None:
        """Call owned(node, centroid) for nodes that one centroid has whole, and owned(rows, centroids) for compared leaves; v is in the tree's order."""
        x, t = v.astype(np.float64), self.tree
        scale = float(max(np.abs(x).max(initial=0), np.abs(self.x).max(initial=0)))
        slack = SLACK * (1 + scale) * math.sqrt(x.shape[1])
        stack: list[tuple[int, list[int], list[int]]] = [(0, [0], [])]  # vectors' node, centroids' nodes, single centroids
        while stack:
            node, groups, single = stack.pop()
            centre, r = x[tree.start[node]], tree.radius[node]
            while True:
                places = [int(t.order[t.start[g]]) for g in groups] + single
                d = np.sqrt(((self.x[places] - centre) ** 2).sum(axis=1))
                reach = d.min() + r + slack  # some centroid is that near to each of the node's vectors
                widths = np.array([t.radius[g] for g in groups] + [0.0] * len(single))
                stays = d - widths - r - slack <= reach
                groups = [g for g, s in zip(groups, stays) if s]
                single = [c for c, s in zip(single, stays[len(stays) - len(single) :]) if s]
                if not groups:
                    break
                opened = groups
                groups = []
                for g in opened:
                    if self.below[g]:
                        groups += self.below[g]
                    else:
                        single += t.order[t.start[g] : t.end[g]].tolist()
            if len(single) == 1:
                owned(node, single[0])
            elif inner := tree.children(node):
                stack += [(i, [], single) for i in inner]
            else:
                single.sort()
                rows = slice(int(tree.start[node]), int(tree.end[node]))
                owned(rows, np.array(single)[_squares(v[rows], self.c[single]).argmin(axis=1)])


NODES = "start array<long>, end array<long>, after array<long>, radius array<double>, sums binary"


def blocks(vectors: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """One row a block: ids, vectors, the tree and its nodes' sums. Blocks are cut from each partition as it comes; no row is shuffled."""
    name, kind = vectors.columns[0], vectors.schema[0].dataType

    def row(ids: list, v: np.ndarray) -> pa.RecordBatch:
        tree = Tree.of(v)
        v = v[tree.order]
        run = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(v, axis=0)])
        sums = run[tree.end] - run[tree.start]
        return pa.RecordBatch.from_pylist([{"ids": [ids[i] for i in tree.order], "v": v.tobytes(), "start": tree.start, "end": tree.end, "after": tree.after, "radius": tree.radius, "sums": sums.tobytes()}], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    longs = pa.list_(pa.int64())
    schema = pa.schema([("ids", pa.list_(to_arrow_type(kind))), ("v", pa.binary()), ("start", longs), ("end", longs), ("after", longs), ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.empty((0, dim), np.int64)
        for b in batches:
            ids += b.column(0).to_pylist()
            held = np.concatenate([held, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)])
            while len(held) >= size:
                yield row(ids[:size], held[:size])
                ids, held = ids[size:], held[size:]
        if len(held):
            yield row(ids, held)

    return vectors.mapInArrow(run, f"ids array<{kind.simpleString()}>, v binary, {NODES}")


def _read(b: pa.RecordBatch, i: int, dim: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """Tree, vectors in its order and the nodes' sums of a row of blocks."""
    col = lambda name: b.column(b.schema.get_field_index(name))[i]
    v, sums = (np.frombuffer(col(n).as_py(), np.int64).reshape(-1, dim) for n in ("v", "sums"))
    return Tree(np.arange(len(v)), *(col(n).values.to_numpy() for n in ("start", "end", "after", "radius"))), v, sums


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    sent = stored.sparkSession.sparkContext.broadcast(centroids)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Descent(sent.value)
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                tree, v, sums = _read(b, i, dim)

                def owned(what, whose) -> None:
                    if isinstance(what, slice):
                        np.add.at(n, whose, 1)
                        np.add.at(total, whose, v[what])
                    else:
                        n[whose] += tree.end[what] - tree.start[what]
                        total[whose] += sums[what]

                to.nearest(tree, v, owned)
        yield pa.record_batch([pa.array(np.repeat(np.arange(k), dim)), pa.array(np.tile(np.arange(dim), k)), pa.array(np.repeat(n, dim)), pa.array(total.ravel())], ["c", "d", "n", "s"])

    parts = stored.select("v", "start", "end", "after", "radius", "sums").mapInArrow(run, "c long, d long, n long, s long")
    rows = parts.groupBy("c", "d").agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        if r.n:
            out[r.c, r.d] = int(r.s) // r.n
    sent.destroy()
    return out


def assigned(stored: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    sent = stored.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Descent(sent.value)
        for b in batches:
            for i in range(b.num_rows):
                tree, v, _ = _read(b, i, dim)
                cluster = np.empty(len(v), np.int64)

                def owned(what, whose) -> None:
                    cluster[what if isinstance(what, slice) else slice(int(tree.start[what]), int(tree.end[what]))] = whose

                to.nearest(tree, v, owned)
                d = v - to.c[cluster]
                yield pa.record_batch([b.column(0)[i].values, pa.array(cluster, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d))], [id_col, "cluster", "distance"])

    kind = stored.schema["ids"].dataType.elementType.simpleString()
    return stored.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, prefix: str = "3:", block: int = BLOCK) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ints = quantized(vectors, id_col, vector_col, dim, scale)
    stored, _ = kept(blocks(ints, dim, block), "blocks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row of blocks is about a megabyte
    try:
        centroids = first_centroids(ints, k, prefix)
        if not len(centroids):
            return spark.createDataFrame([], f"`{id_col}` {ints.schema[0].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        for _ in range(rounds):
            centroids = moved(stored, centroids)
        found, _ = kept(assigned(stored, centroids, id_col), "clusters")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # k rows at most go to the driver and back.
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(i, inertia.get(i), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_centroids": op13_centroids}

_D = "list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_NEAREST = f"SELECT vec_id, v, num, d FROM (SELECT v.vec_id, v.v, c.num, CAST({_D} AS BIGINT) AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_D}, c.num) AS place FROM v, c{{r}} AS c) WHERE place = 1"
_ROUNDS = ", ".join(
    f"""a{r} AS MATERIALIZED ({_NEAREST.format(r=r)}),
s{r} AS MATERIALIZED (SELECT num, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT num, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY num, i),
c{r + 1} AS MATERIALIZED (SELECT c.num, coalesce(t.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY num) AS t ON t.num = c.num)"""
    for r in range(10)
)
SQL = {
    "op13_centroids": f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS num, v FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{_ROUNDS}, a10 AS MATERIALIZED ({_NEAREST.format(r=10)})
SELECT a.vec_id, a.num AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.num) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 AS a JOIN c10 AS c ON c.num = a.num"""
}
