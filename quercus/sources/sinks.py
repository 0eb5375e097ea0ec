"""Writers (inventory Z1, Z3, Z4, Z6, Z7, Z9, Z12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# BibTeX entry types.
ENTRY_TYPES = {"ARTIGO": "article", "LIVRO": "book", "CAPITULO": "incollection", "EVENTO": "inproceedings"}


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Json, csv (semicolons, each file with a header after a byte order mark) or xml."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        first = df.columns[0]
        w = df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite")
        w.option("header", True).option("sep", ";").csv(path)
    elif kind == "xml":
        w.format("xml").option("rootTag", "rows").option("rowTag", "row").save(path)
    else:
        w.json(path)


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r'(["{}\\$])', r"\\$1")


def bibtex(items: DataFrame) -> DataFrame:
    """Z3: one entry a row. items: id, owner, item_type, title, year, authors (array), journal_name, pages, doi.

    The key is the first eight bytes of the owner's name that are letters or digits, the year and _id.
    """
    kind = F.create_map(*(F.lit(x) for kv in ENTRY_TYPES.items() for x in kv))
    key = F.concat(F.regexp_replace(F.substring("owner", 1, 8), "[^A-Za-z0-9]", ""), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("_"), F.col("id").cast("string"))
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), _escaped(c), F.lit("}")))
    lines = F.concat_ws(
        ",\n", line("title", F.col("title")), line("author", F.array_join("authors", " and ")), line("year", F.col("year").cast("string")), line("journal", F.col("journal_name")),
        line("pages", F.regexp_replace("pages", "-+", "--")), line("doi", F.trim("doi")),
    )
    return items.select("id", F.concat(F.lit("@"), F.coalesce(kind[F.col("item_type")], F.lit("misc")), F.lit("{"), key, F.lit(",\n"), lines, F.lit("\n}")).alias("entry"))


def write_evidence(evidence: DataFrame, path: str, meta: str) -> None:
    """Gzipped JSON lines sorted by source, record and title, the `_meta` line first."""
    spark = evidence.sparkSession
    lines = evidence.select("src", "rec", "title", F.to_json(F.struct(*evidence.columns)).alias("value"))
    head = spark.range(1).select(F.lit("").alias("src"), F.lit("").alias("rec"), F.lit("").alias("title"), F.lit(f'{{"_meta": {meta}}}').alias("value"))
    head.unionByName(lines).repartitionByRange("src", "rec", "title").sortWithinPartitions("src", "rec", "title").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def swap(spark: SparkSession, write: Callable[[str], None], folder: str, version: str) -> str:
    """Let `write` fill a new version, then point to it; a failure leaves the old one in place. Returns the path that now holds.

    Pointers are files `CURRENT-<number>` that are made by one rename and never changed: the highest number holds, and the one
    before stays until a later swap, so there is no moment without a version.
    """
    path = f"{folder}/v={version}"
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(folder).getFileSystem(hadoop)
    if fs.exists(make(path)):
        raise FileExistsError(path)
    write(path)
    numbers = _pointers(spark, folder)
    new = max(numbers, default=0) + 1
    draft = make(f"{folder}/.draft-{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(draft, make(f"{folder}/CURRENT-{new:010d}")):
        raise OSError("the new version couldn't be pointed to")
    for n in sorted(numbers)[:-1]:
        fs.delete(make(f"{folder}/CURRENT-{n:010d}"), False)
    return path


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-")]


def current(spark: SparkSession, folder: str) -> str:
    """The path of the version that the last whole `swap` pointed to."""
    numbers = _pointers(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"no version under {folder}")
    return f"{folder}/v={spark.read.text(f'{folder}/CURRENT-{max(numbers):010d}').first()[0]}"


def copy_tables(spark: SparkSession, read: Callable[[str], DataFrame], tables: dict[str, Callable[[DataFrame], DataFrame]], folder: str, replace: bool = False) -> dict[str, int]:
    """Tables of a foreign schema, each changed by its function, to Parquet under folder; the rows of each.

    `read` gives a table by name, for example `lambda t: spark.read.jdbc(url, t, properties=p)`. Targets that have rows stop it before anything is written, unless they may be replaced.
    """
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    filled = [t for t in tables if fs.exists(make(f"{folder}/{t}")) and not spark.read.parquet(f"{folder}/{t}").isEmpty()]
    if filled and not replace:
        raise FileExistsError(f"these tables have rows: {', '.join(filled)}")
    for name, change in tables.items():
        change(read(name)).write.mode("overwrite").parquet(f"{folder}/{name}")
    return {t: spark.read.parquet(f"{folder}/{t}").count() for t in tables}
