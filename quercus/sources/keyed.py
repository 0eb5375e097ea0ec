"""A stored table with a key that takes batches: upserts that rewrite only what they touch (inventory Z8).

Rows are dealt into ranges of the key's hash; every range is a folder of files that never change. A batch reads the ranges of its own keys,
writes them anew beside the old ones, and one rename makes a new list of folders current: readers see all of a batch or nothing, and files of other ranges stay as
they are. A batch that fails leaves only files that no list names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What becomes of a column whose key is there: (stored, new) -> value. A rule can also be a function like these.
RULES = {
    "replace": lambda old, new: new,
    "keep": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(F.when(old.cast("string") != "", old), new),
    "latest": lambda old, new: F.coalesce(new, old),
    "add": lambda old, new: F.when(old.isNull() | new.isNull(), F.coalesce(old, new)).otherwise(old + new),
    "greatest": lambda old, new: F.greatest(old, new),
    "least": lambda old, new: F.least(old, new),
}
#: How rows of one key within a batch become one, by the same rules, in the order that the batch gives.
_FOLDS = {"keep": "first", "fill": "first", "add": "sum", "greatest": "max", "least": "min"}


class _Listed:
    """A folder whose current state is the last whole list in it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        p = self.hadoop.Path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return sorted(int(n.removeprefix("LIST-")) for n in names if n.startswith("LIST-"))

    def _point(self, state: dict, number: int) -> None:
        draft = self.hadoop.Path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(draft, self.hadoop.Path(f"{self.folder}/LIST-{number:010d}")):
            raise OSError("another batch came first")

    def state(self) -> tuple[dict, int]:
        numbers = self._lists()
        if not numbers:
            raise FileNotFoundError(f"no table under {self.folder}")
        lines = self.spark.read.text(f"{self.folder}/LIST-{numbers[-1]:010d}", wholetext=True).first()[0]
        return json.loads(lines), numbers[-1]

class PartedTable(_Listed):
    """A table whose parts (sources) are each replaced as a whole: a part's new load retires its old rows, and no other part's.

    Every load has a name and stays readable; a load that fails, or whose name the part has had, changes nothing.
    """

    def load(self, part: str, rows: DataFrame, batch: str) -> None:
        numbers = self._lists()
        state = self.state()[0] if numbers else {"schema": rows.schema.jsonValue(), "parts": {}}
        loads = state["parts"].get(part, [])
        if any(x["batch"] == batch for x in loads):
            raise FileExistsError(f"{part} has a load {batch}")
        path = f"{self.folder}/data-{uuid.uuid4().hex[:12]}"
        rows.select(*(f["name"] for f in state["schema"]["fields"])).write.option("compression", "zstd").parquet(path)
        self._point(state | {"parts": state["parts"] | {part: [*loads, {"batch": batch, "path": path}]}}, (numbers[-1] if numbers else 0) + 1)

    def read(self, part: str | None = None, batch: str | None = None) -> DataFrame:
        """The current rows of all parts or one, with part and batch; of an earlier load if one is named."""
        state = self.state()[0] if self._lists() else {"schema": StructType([]).jsonValue(), "parts": {}}
        schema = StructType.fromJson(state["schema"])
        out = self.spark.createDataFrame([], StructType([*schema.fields]).add("part", "string").add("batch", "string"))
        for name, loads in state["parts"].items():
            chosen = [x for x in loads if x["batch"] == batch] if batch else loads[-1:]
            for x in chosen if part in (None, name) else []:
                out = out.unionByName(self.spark.read.schema(schema).parquet(x["path"]).withColumns({"part": F.lit(name), "batch": F.lit(x["batch"])}))
        return out


class KeyedTable(_Listed):
    """The table under a folder. Keys are columns without nulls, which together are unique; rows whose key has a null are an error."""

    @classmethod
    def create(cls, df: DataFrame, folder: str, keys: list[str], ranges: int = 64) -> KeyedTable:
        """A new table of these rows. ranges: about as many as batches should be able to leave alone; it stays as it is."""
        table = cls(df.sparkSession, folder)
        if table._lists():
            raise FileExistsError(folder)
        state = {"keys": keys, "ranges": ranges, "schema": df.schema.jsonValue(), "folders": {}}
        state["folders"] = table._written(df, state)
        table._point(state, 1)
        return table

    def _range(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["ranges"])).cast("int")

    def _written(self, df: DataFrame, state: dict) -> dict[str, str]:
        """The folders, by range, of a version's files."""
        path = f"{self.folder}/data-{uuid.uuid4().hex[:12]}"
        null = F.lit(False)
        for k in state["keys"]:
            null = null | F.col(k).isNull()
        first = state["keys"][0]
        checked = df.withColumn(first, F.when(null, F.raise_error(F.lit("a key is null")).cast(df.schema[first].dataType)).otherwise(F.col(first)))
        checked.withColumn("__range", self._range(state)).repartition("__range").write.option("compression", "zstd").partitionBy("__range").parquet(path)
        there = self.hadoop.Path(path)
        names = [x.getPath().getName() for x in self.fs.listStatus(there)]
        return {n.partition("=")[2]: f"{path}/{n}" for n in names if n.startswith("__range=")}

    def read(self, ranges: list[str] | None = None) -> DataFrame:
        """The table's rows, or those of some ranges."""
        state, _ = self.state()
        schema = StructType.fromJson(state["schema"])
        folders = [f for r, f in state["folders"].items() if ranges is None or r in ranges]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, rules: dict[str, str] | None = None, ignore: bool = False, order: Column | None = None) -> list[str]:
        """Take a batch's rows; the ranges that it rewrote. rules: column -> name in RULES, `replace` where none is given. With ignore, rows whose key is there are left out.

        Columns that the batch doesn't have stay, and are null in new rows. Rows of one key within the batch become one first, in the given order (else in that of their values).
        """
        state, number = self.state()
        keys = state["keys"]
        old_columns = [f["name"] for f in state["schema"]["fields"]]
        given = [c for c in batch.columns if c in old_columns and c not in keys]
        rule = {c: (rules or {}).get(c, "replace") for c in given}
        at = order if order is not None else F.struct(*given) if given else F.lit(0)
        fold = {"first": lambda c: F.min_by(c, "__at"), "sum": F.sum, "max": F.max, "min": F.min}
        one = lambda c: F.max_by(c, "__at") if rule[c] not in _FOLDS else fold[_FOLDS[rule[c]]](c)
        if ignore:
            one = lambda c: F.min_by(c, "__at")
        b = batch.withColumn("__at", at).groupBy(*keys).agg(*(one(c).alias(f"__{c}") for c in given), F.lit(True).alias("__in"))
        touched = sorted(str(r[0]) for r in batch.select(self._range(state)).distinct().collect())  # at most as many as there are ranges
        if not touched:
            return []
        stored = self.read(touched).withColumn("__has", F.lit(True))
        types = {f["name"]: stored.schema[f["name"]].dataType for f in state["schema"]["fields"]}
        j = stored.join(b, keys, "full_outer")
        value = lambda c: F.when(F.col("__has") & F.col("__in"), F.col(c) if ignore else RULES[rule[c]](F.col(c), F.col(f"__{c}").cast(types[c]))).when(F.col("__has"), F.col(c)).otherwise(F.col(f"__{c}").cast(types[c]))
        out = j.select(*(F.col(c) if c in keys or c not in given else value(c).alias(c) for c in old_columns))
        new = self._written(out, state)
        self._point(state | {"folders": {r: f for r, f in state["folders"].items() if r not in touched} | new}, number + 1)
        return touched
