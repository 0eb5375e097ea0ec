"""Merges of journals, institutions, countries and authors (inventory B22).

A merge says that one entity becomes another, and that one may be merged on in its turn. `roots` follows such chains by pointer
jumping, which doubles the reach of every pointer in a round, so a chain of n takes log n joins; a ring of merges is an error. Then
every table that refers to the entities is carried over: names become variations of the entity that stays, identifiers are moved and
rows that become equal are one, other references are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..plans.storage import stored


def roots(merges: DataFrame) -> DataFrame:
    """old, new: every merged id with the id at the end of its chain. merges: old, new.

    Merges into itself and repeated rows don't count; an id that is merged into several others, or a ring, is an error. Nulls are left out.
    """
    m = merges.select("old", "new").where("old IS NOT NULL AND new IS NOT NULL AND old <> new").distinct()
    m, _ = stored(m, "merges")
    total, olds = m.agg(F.count(F.lit(1)), F.countDistinct("old")).first()
    if total != olds:
        raise ValueError(f"{total - olds} merges send an id to several others")
    for _ in range(max(1, total).bit_length() + 1):
        further = m.select(F.col("old").alias("new"), F.col("new").alias("next"))
        j = m.join(further, "new", "left")
        open_ = j.where("next IS NOT NULL").count()
        if not open_:
            return m
        m, _ = stored(j.select("old", F.coalesce("next", "new").alias("new")), "merges")
    raise ValueError("the merges hold a ring")


def carried(df: DataFrame, column: str, ends: DataFrame, unique: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """df with the ids of `column` at the ends of their chains. With unique, of rows that are then equal in column and those columns that of the smallest id stays."""
    to = ends.select(F.col("old").alias(column), F.col("new").alias("__to"))
    out = df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*df.columns)
    if unique is None:
        return out
    w = Window.partitionBy(column, *unique).orderBy(id_col)
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged(entities: DataFrame, variations: DataFrame, ends: DataFrame, names: list[str], chosen: DataFrame | None = None, kind: str = "alternative") -> tuple[DataFrame, DataFrame]:
    """The entities that stay, and all variations with the merged entities' names among them.

    entities: id, names ... and further columns; names[0] is the name that an entity goes by. variations: entity_id, name, key, kind. chosen: id, column, value:
    columns of an entity that stays which take another value (an empty one becomes null, but not the name itself). New variations are what the merged entities
    and the one that stays are called or have as variations, but the latter's name; once a key, which is the normalised name in capitals; of several spellings
    the one of the smallest id, then of the first column.
    """
    groups = ends.select("new").distinct().select(F.col("new").alias("id"))
    stay = entities.join(ends.select(F.col("old").alias("id")), "id", "left_anti")
    if chosen is not None:
        c = chosen.groupBy("id").pivot("column", [x for x in entities.columns if x != "id"]).agg(F.max("value"))
        c = c.select("id", *(F.col(x).alias(f"__{x}") for x in c.columns if x != "id"))
        keep = lambda x: F.when(F.col(f"__{x}").isNull() | ((F.col(f"__{x}") == "") if x == names[0] else F.lit(False)), F.col(x)).otherwise(F.nullif(F.col(f"__{x}"), F.lit("")).cast(entities.schema[x].dataType))
        stay = stay.join(c, "id", "left").select("id", *(keep(x).alias(x) for x in entities.columns if x != "id"))
    members = ends.select(F.col("old").alias("id"), F.col("new").alias("entity_id")).unionByName(groups.select("id", F.col("id").alias("entity_id")))
    own = entities.join(members, "id").select("entity_id", "id", F.posexplode(F.array(*names)).alias("place", "name"))
    given = variations.withColumnRenamed("entity_id", "id").join(members, "id").select("entity_id", "id", F.lit(len(names)).alias("place"), "name")
    called = stay.select(F.col("id").alias("entity_id"), F.col(names[0]).alias("__called"))
    found = own.unionByName(given).withColumn("name", F.trim("name")).where("name <> ''").join(called, "entity_id").where(~F.col("name").eqNullSafe(F.col("__called")))
    found = found.withColumn("key", normalized(F.col("name"), upper=True)).where("key <> ''")
    first = found.groupBy("entity_id", "key").agg(F.min(F.struct("id", "place", "name")).alias("x")).select("entity_id", "key", F.col("x.name").alias("name"))
    kept = variations.join(ends.select(F.col("old").alias("entity_id")), "entity_id", "left_anti").select("entity_id", "name", "key", "kind")
    new = first.join(kept.select("entity_id", "key"), ["entity_id", "key"], "left_anti").select("entity_id", "name", "key", F.lit(kind).alias("kind"))
    return stay, kept.unionByName(new)


def merged_authors(identities: DataFrame, variants: DataFrame, identifiers: DataFrame, merges: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Authors: identities (id, preferred_name, ...), variants (entity_id, name, key, kind) and identifiers (id, entity_id, provider, identifier, ...), of which equal ones become one."""
    ends = roots(merges)
    stay, names = merged(identities, variants, ends, ["preferred_name"], chosen, "merge")
    return stay, names, carried(identifiers, "entity_id", ends, ["provider", "identifier"])


def merged_institutions(institutions: DataFrame, variants: DataFrame, merges: DataFrame, dependents: dict[str, tuple[DataFrame, str]], chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Institutions (id, official_name, short_name, acronym, corporate_name, ...), their variants, and the tables that refer to them: name -> (table, column)."""
    ends = roots(merges)
    stay, names = merged(institutions, variants, ends, ["official_name", "short_name", "acronym", "corporate_name"], chosen)
    return stay, names, {t: carried(df, c, ends) for t, (df, c) in dependents.items()}


def merged_countries(countries: DataFrame, variants: DataFrame, merges: DataFrame, dependents: dict[str, tuple[DataFrame, str]], chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Countries (id, common_name, official_name, ...), their variants, and the tables that refer to them."""
    ends = roots(merges)
    stay, names = merged(countries, variants, ends, ["common_name", "official_name"], chosen)
    return stay, names, {t: carried(df, c, ends) for t, (df, c) in dependents.items()}
