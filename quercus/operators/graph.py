"""Co-authorship (inventory J1, J2, A24, A25, A37-A39, T9, T10).

A work that is stored once for each owner makes each pair once: pairs come from the set of its matched authors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.storage import numbered, stored


#: Authors of a work that meet in one cell of pairs.
BLOCK = 1000
#: Researchers of one side of a table of weights (64 MB), the least number of sides, and researchers that are broadcast.
SIDE, SIDES, BROADCAST = 4096, 8, 1_000_000
#: Rows of works with one hash from which they may be too many for one task, and the number of hashes.
HEAVY, HASHES = 200_000, 65_536


def authorships(authors: DataFrame) -> DataFrame:
    """Distinct (work, researcher) of matched authors. authors: work, matched_researcher_id."""
    return authors.where("matched_researcher_id IS NOT NULL AND work IS NOT NULL").select("work", F.col("matched_researcher_id").alias("researcher")).distinct()


def edges(authors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Unordered pairs a < b with the number of works they share.

    Each work's authors are gathered as a set, of which the pairs are read off: no self-join, and rows are added up before they move. Only if a work has over `block` rows (a count, made
    first) such works are dealt into blocks of about that size: a row meets its own block and, as either side, every other block of its work, so a work with very
    many authors spreads over many tasks, and each pair is still made once.
    """
    rows = authors.where("matched_researcher_id IS NOT NULL AND work IS NOT NULL").select("work", F.col("matched_researcher_id").alias("researcher"))
    heavy = rows.groupBy("work").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("work")
    cells = None
    if not heavy.isEmpty():
        heavy, _ = stored(heavy, "large-works")
        cells = _cells(rows.join(heavy, "work", "left_semi").distinct(), block)
        rows = rows.join(heavy, "work", "left_anti")
    sets = rows.groupBy("work").agg(F.collect_set("researcher").alias("s")).where(F.size("s") > 1)
    pairs = sets.select("s", F.explode("s").alias("a")).select("a", F.explode(F.filter("s", lambda y: y > F.col("a"))).alias("b"))
    if cells is not None:
        pairs = pairs.unionByName(cells.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _cells(x: DataFrame, block: int) -> DataFrame:
    """Pairs x, y of distinct rows of works with many authors."""
    n = x.groupBy("work").agg(F.count(F.lit(1)).alias("n"))
    y = x.join(n, "work").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    y = y.withColumn("i", F.pmod(F.xxhash64("researcher"), F.col("blocks").cast("long")).cast("int"))
    # Of blocks i <= j the cell (i, j) has i's rows on the left and j's on the right.
    left = y.select("work", F.col("researcher").alias("x"), "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    right = y.select("work", F.col("researcher").alias("y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    return left.join(right, ["work", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y")


def strongest(edge: DataFrame, limit: int = 120) -> DataFrame:
    """The strongest edges; ties by the ids."""
    return edge.orderBy(F.desc("weight"), "a", "b").limit(limit)


def strongest_pairs(authors: DataFrame, people: DataFrame, limit: int, side: int = SIDE, heavy: int = HEAVY) -> DataFrame:
    """The strongest edges among people (researcher), ties by the ids, of networks whose edges are too many to be moved.

    Researchers are numbered and dealt into parts of up to `side`. Each two parts are a cell: it gets from every work its authors of the one and of the other, adds up all their pairs in one
    table of weights, and gives out its `limit` strongest. So every pair is counted whole in one place, what moves is each work's authors once for each part, and a task holds one table, however many rows come.
    """
    ids, _ = stored(numbered(people.select("researcher").distinct(), "researcher", -1, "n"), "people")
    size = ids.count()
    parts = max(SIDES, -(-size // side))
    known = F.broadcast(ids) if size <= BROADCAST else ids
    rows = authors.select("work", F.col("matched_researcher_id").alias("researcher")).join(known, "researcher")
    # Stored, so that the work's key is made once.
    rows, _ = stored(rows.select("work", (F.col("n") % parts).cast("int").alias("part"), F.floor(F.col("n") / parts).cast("short").alias("at")), "authorships")
    # Rows of a work go to one task, unless its hash has very many.
    rows = rows.where("work IS NOT NULL").withColumn("hash", F.pmod(F.xxhash64("work"), F.lit(HASHES)))
    many, _ = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > heavy).select("hash"), "large-works")
    if many.isEmpty():
        sets = _in_parts(rows.repartition("work"))
    else:
        sets = _in_parts(rows.join(many, "hash", "left_anti").repartition("work")).unionByName(_in_parts(rows.join(many, "hash", "left_semi")))
    one, other = F.col("one"), F.col("other")
    cells = sets.select("parts", F.explode("parts").alias("one")).select("one", F.explode(F.filter("parts", lambda y: y["part"] >= one["part"])).alias("other"))
    inside = one["part"] == other["part"]
    cells = cells.where(~inside | (F.size(one["at"]) > 1)).select((one["part"].cast("long") * parts + other["part"]).alias("cell"), one["at"].alias("x"), F.when(inside, F.array().cast("array<smallint>")).otherwise(other["at"]).alias("y"))
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_heaviest(size, parts, limit), "a long, b long, weight long")
    top = strongest(found, limit)
    of = lambda c: known.select(F.col("n").alias(c), F.col("researcher").alias(f"{c}_id"))
    return top.join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "weight")


def _in_parts(rows: DataFrame) -> DataFrame:
    """Of each work with two authors or more, its distinct authors by part."""
    sets = rows.groupBy("work", "part").agg(F.collect_set("at").alias("at")).groupBy("work").agg(F.collect_list(F.struct("part", "at")).alias("parts"))
    return sets.where((F.size("parts") > 1) | (F.size(F.col("parts")[0]["at"]) > 1)).select("parts")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several runs, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _count(table: np.ndarray, x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray) -> None:
    """One for each pair of a row of x and the same row of y; rows are distinct values between the places xs, or ys."""
    flat, left, right, one = table.reshape(-1), x.astype(np.int64) * table.shape[1], y.astype(np.int64), table.dtype.type(1)
    nx, ny = np.diff(xs), np.diff(ys)
    n = nx * ny
    for r in np.flatnonzero(n >= 400).tolist():
        flat[left[xs[r] : xs[r + 1], None] + right[ys[r] : ys[r + 1]]] += one
    # Many short rows at once, up to some million pairs.
    rest = np.flatnonzero((n > 0) & (n < 400))
    for some in np.split(rest, np.flatnonzero(np.diff(np.cumsum(n[rest]) // 2_000_000)) + 1):
        there, starts = np.repeat(ny[some], nx[some]), np.repeat(ys[some], nx[some])
        np.add.at(flat, np.repeat(left[_spans(xs[some], nx[some])], there) + right[_spans(starts, there)], one)


def _heaviest(size: int, parts: int, limit: int):
    """From rows by cell, in which a work has its authors x and y of two parts (or x alone: of one), the `limit` strongest pairs of each cell."""
    side = max(1, -(-size // parts))

    def top(cell: int, table: np.ndarray) -> pa.RecordBatch:
        i, j = divmod(cell, parts)
        a, b, w = (np.zeros(0, np.int64) for _ in range(3))
        for first in range(0, side, 256):
            rows = np.triu(table[first : first + 256], first + 1) if i == j else table[first : first + 256]
            at = np.flatnonzero(rows >= max(1, w.min() if len(w) == limit else 1))
            left, right = (at // side + first) * parts + i, at % side * parts + j
            a, b, w = np.append(a, np.minimum(left, right)), np.append(b, np.maximum(left, right)), np.append(w, rows.reshape(-1)[at].astype(np.int64))
            if len(w) > limit:
                least = np.partition(w, len(w) - limit)[len(w) - limit]
                over, tied = np.flatnonzero(w > least), np.flatnonzero(w == least)
                left_over = limit - len(over)
                kept = np.append(over, tied[np.argpartition(a[tied] * size + b[tied], left_over - 1)[:left_over]])
                a, b, w = a[kept], b[kept], w[kept]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w)], ["a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, open_ = np.zeros((side, side), np.uint32), None
        for batch in batches:
            cells, (x, y) = batch.column(0).to_numpy(), (batch.column(c) for c in (1, 2))
            values = [c.values.to_numpy() for c in (x, y)]
            places = [c.offsets.to_numpy().astype(np.int64) for c in (x, y)]
            ends = [*np.flatnonzero(np.diff(cells)) + 1, len(cells)] if len(cells) else []
            for start, end in zip([0, *ends], ends):
                if cells[start] != open_:
                    if open_ is not None:
                        yield top(open_, table)
                        table.fill(0)
                    open_ = int(cells[start])
                k = 0 if open_ // parts == open_ % parts else 1
                _count(table, values[0], places[0][start : end + 1], values[k], places[k][start : end + 1])
        if open_ is not None:
            yield top(open_, table)

    return run


def shared_works(authors: DataFrame) -> DataFrame:
    """The number of works with two or more matched authors; no pair is made."""
    return authorships(authors).groupBy("work").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("shared_works"))


def network_stats(authors: DataFrame) -> DataFrame:
    """Of each researcher the distinct co-authors and distinct shared works; each is counted on its own, works without any pair."""
    x = authorships(authors)
    several = x.groupBy("work").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("work")
    shared = x.join(several, "work", "left_semi").groupBy("researcher").agg(F.count(F.lit(1)).alias("shared_works"))
    e = edges(authors)
    near = e.select(F.col("a").alias("researcher")).unionByName(e.select(F.col("b").alias("researcher"))).groupBy("researcher").agg(F.count(F.lit(1)).alias("coauthors"))
    return near.join(shared, "researcher")


def neighbours(authors: DataFrame, researcher: int) -> DataFrame:
    """The co-authors of one researcher and the works shared with each."""
    x = authorships(authors)
    mine = x.where(F.col("researcher") == researcher).select("work")
    return x.join(mine, "work", "left_semi").where(F.col("researcher") != researcher).groupBy("researcher").agg(F.count(F.lit(1)).alias("works"))


def nodes(edge: DataFrame) -> DataFrame:
    """Degree and strength of each node."""
    both = edge.select(F.col("a").alias("id"), "weight").unionByName(edge.select(F.col("b").alias("id"), "weight"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def ego(edge: DataFrame, focus: int) -> DataFrame:
    """The edges between a researcher and its neighbours, and among these."""
    near = edge.where((F.col("a") == focus) | (F.col("b") == focus)).select(F.when(F.col("a") == focus, F.col("b")).otherwise(F.col("a")).alias("id"))
    inside = near.unionByName(edge.sparkSession.range(1).select(F.lit(focus).cast("long").alias("id"))).distinct()
    return edge.join(inside.select(F.col("id").alias("a")), "a", "left_semi").join(inside.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "weight")


def matrix_nodes(edge: DataFrame, people: DataFrame) -> DataFrame:
    """Those with a partner or more, with their place by folded name, then id. people: id, full_name."""
    ids = edge.select(F.col("a").alias("id")).unionByName(edge.select(F.col("b").alias("id"))).distinct()
    named = people.join(ids, "id", "left_semi").select("id", "full_name", fold(F.col("full_name")).alias("f"))
    return numbered(named, ["f", "id"], 0, "place").select("id", "full_name", F.col("place").cast("int").alias("place"))


def matrix(edge: DataFrame) -> DataFrame:
    """The symmetric sparse matrix."""
    return edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def bridges(edge: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (not works) between groups, symmetric. groups: id, grp."""
    g = groups.where("grp IS NOT NULL")
    e = edge.join(g.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b")
    rows = e.select("ga", "gb").unionByName(e.where("ga <> gb").select(F.col("gb").alias("ga"), F.col("ga").alias("gb")))
    return rows.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("pairs"))


def pair_works(authors: DataFrame, a: int, b: int) -> DataFrame:
    """Works that both wrote."""
    x = authorships(authors)
    return x.where(F.col("researcher") == a).select("work").join(x.where(F.col("researcher") == b).select("work"), "work", "left_semi")


def pair_page(works: DataFrame, limit: int = 200) -> DataFrame:
    """The latest works of a pair, up to the limit, each with the total that there are. works: work, year. Ties by work."""
    total = works.agg(F.count(F.lit(1)).alias("total"))
    return works.orderBy(F.desc_nulls_last("year"), "work").limit(limit).crossJoin(total)  # one row
