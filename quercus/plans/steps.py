"""Steps with stored outputs, which go on where they stopped (inventory B31).

A step is a function from tables to tables. Its outputs are Parquet under the folder of its fingerprint, which follows from its name, its version and the fingerprints of
the tables it reads; the table of a finished step is taken again as long as that is the same. So a run after an error, or after a driver that died, does only what is
left, and a changed source redoes only what hangs on it. Order is the list's; the first error stops the run and names its step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .bindings import folder_state

Tables = dict[str, DataFrame]


BROADCAST, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Meanwhile joins broadcast a side only by the size that its shuffle had, under the session's threshold.

    The size of a stored table is estimated from its compressed files: that of millions of ids in order is so small that they would be gathered in the driver.
    """
    before = {n: spark.conf.get(n, None) for n in (BROADCAST, ADAPTIVE)}
    spark.conf.set(ADAPTIVE, before[ADAPTIVE] or spark.conf.get(BROADCAST))
    spark.conf.set(BROADCAST, "-1")
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@dataclass
class Step:
    """name, what it reads, and its function: it gets those tables by name and returns tables by name. `when` tells from the tables' names whether it has anything to do; optional tables are
    read where they are there."""

    name: str
    reads: list[str]
    run: Callable[[Tables], Tables]
    version: int = 1
    when: Callable[[set[str]], bool] = field(default=lambda tables: True)
    optional: list[str] = field(default_factory=list)


class Failed(RuntimeError):
    """A step failed; the ones before it are stored."""

    def __init__(self, step: str, report: list[tuple[str, str]]) -> None:
        super().__init__(f"step {step!r} failed after {[n for n, _ in report]}")
        self.step, self.report = step, report


class Pipeline:
    """Steps over sources in a folder that all executors share. sources: name -> path of a Parquet table, which is known by its files, or a DataFrame, which is taken to change with every run."""

    def __init__(self, spark: SparkSession, folder: str, steps: list[Step]) -> None:
        if len({s.name for s in steps}) != len(steps):
            raise ValueError("two steps have one name")
        self.spark, self.folder, self.steps = spark, folder, steps
        self.make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def chosen(self, only: list[str] | None = None, skip: list[str] | None = None, first: str | None = None) -> list[Step]:
        names = [s.name for s in self.steps]
        if unknown := [n for n in [*(only or []), *(skip or []), *([first] if first else [])] if n not in names]:
            raise ValueError(f"no step {', '.join(unknown)}; there are {', '.join(names)}")
        out = self.steps[names.index(first) if first else 0 :]
        return [s for s in out if (not only or s.name in only) and s.name not in (skip or [])]

    def run(self, sources: dict[str, str | DataFrame], only: list[str] | None = None, skip: list[str] | None = None, first: str | None = None) -> tuple[Tables, list[tuple[str, str]]]:
        """The tables after all steps, and each step's state: done, kept (stored by an earlier run) or skipped.

        Of steps that aren't chosen the outputs of the last run that finished them are read.
        """
        tables: Tables = {n: self.spark.read.parquet(x) if isinstance(x, str) else x for n, x in sources.items()}
        prints = {n: folder_state(self.spark, x) if isinstance(x, str) else "given" for n, x in sources.items()}
        report: list[tuple[str, str]] = []
        wanted = {s.name for s in self.chosen(only, skip, first)}
        for step in self.steps:
            reads = [*step.reads, *(n for n in step.optional if n in tables)]
            print_ = hashlib.sha256("|".join([step.name, str(step.version), *(f"{n}={prints.get(n, '')}" for n in reads)]).encode()).hexdigest()[:20]
            path = f"{self.folder}/{step.name}/{print_}"
            done = self._done(path)
            if step.name in wanted and not step.when(set(tables)):
                report.append((step.name, "skipped"))
                continue
            if step.name in wanted and (done is None or any(prints.get(n) == "given" for n in reads)):
                try:
                    if missing := [n for n in reads if n not in tables]:
                        raise KeyError(f"no table {', '.join(missing)}")
                    with measured_broadcasts(self.spark):
                        done = self._store(path, step.run({n: tables[n] for n in reads}))
                except Exception as e:
                    raise Failed(step.name, report) from e
                report.append((step.name, "done"))
            elif step.name in wanted:
                report.append((step.name, "kept"))
            else:
                path, done = self._last(step.name)
            given = step.name in wanted and any(prints.get(n) == "given" for n in reads)
            for name in done or []:
                tables[name] = self.spark.read.parquet(f"{path}/{name}")
                prints[name] = "given" if given else path
        return tables, report

    def _store(self, path: str, out: Tables) -> list[str]:
        for name, df in out.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        mark = self.fs.create(self.make(f"{path}/.draft"), True)
        mark.write(bytearray(",".join(out).encode()))
        mark.close()
        self.fs.delete(self.make(f"{path}/DONE"), False)
        if not self.fs.rename(self.make(f"{path}/.draft"), self.make(f"{path}/DONE")):
            raise OSError("the step couldn't be marked as done")
        return list(out)

    def _done(self, path: str) -> list[str] | None:
        """The names of a finished step's tables."""
        if not self.fs.exists(self.make(f"{path}/DONE")):
            return None
        rows = self.spark.read.text(f"{path}/DONE").collect()
        return [n for n in (rows[0][0] if rows else "").split(",") if n]

    def _last(self, name: str) -> tuple[str, list[str] | None]:
        top = self.make(f"{self.folder}/{name}")
        found = []
        for x in self.fs.listStatus(top) if self.fs.exists(top) else []:
            mark = self.make(f"{self.folder}/{name}/{x.getPath().getName()}/DONE")
            if self.fs.exists(mark):
                found.append((self.fs.getFileStatus(mark).getModificationTime(), f"{self.folder}/{name}/{x.getPath().getName()}"))
        return (max(found)[1], self._done(max(found)[1])) if found else ("", None)
