"""Research projects (inventory W1, W2, B26, B27, A56, F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import project_key
from ..functions.rules import funder_nature, project_nature, project_period, project_status
from ..functions.text import fold, normalized
from ..plans.filters import fold_text


def grouped(projects: DataFrame) -> DataFrame:
    """Every record with its group, the group's size and the place of the record in it (1 represents it)."""
    g = projects.withColumn("grp", F.coalesce(project_key(), F.concat(F.lit("#"), F.col("id").cast("string"))))
    w = Window.partitionBy("grp")
    order = w.orderBy(F.desc("is_coordinator"), F.desc(F.length(F.coalesce("description", F.lit("")))), "id")
    return g.withColumns({"place": F.row_number().over(order), "records": F.count(F.lit(1)).over(w)})


def catalogue(projects: DataFrame) -> DataFrame:
    """One row a group: its representative, records and declaring researchers."""
    rep = grouped(projects).where("place = 1").select("grp", "id", "name", "status", "records")
    g = projects.select(F.coalesce(project_key(), F.concat(F.lit("#"), F.col("id").cast("string"))).alias("grp"), "researcher_id")
    return rep.join(g.groupBy("grp").agg(F.countDistinct("researcher_id").alias("declarers")), "grp").drop("grp")


def presented(projects: DataFrame, members: DataFrame, funders: DataFrame) -> DataFrame:
    """One row a group: representative, first filled description, declaring researchers (coordinators first), team and funders.

    The team is the representative's; where that has none, the largest one of the group (ties: the first record). Funders are those of all records, one for each normalised
    name with the natures of its funding; without any, the records' first financiers. members: project_id, full_name, is_responsible; funders: project_id, name, nature.
    """
    g = grouped(projects)
    records = g.select("grp", F.col("id").alias("project_id"), "place", "researcher_id", "is_coordinator", "description", "agency_financier")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    d = records.where(text("description") != "").groupBy("grp").agg(F.min_by(text("description"), "place").alias("description"))
    who = records.groupBy("grp", "researcher_id").agg(F.max(F.col("is_coordinator").cast("int")).alias("leads")).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("leads")).alias("l"), "researcher_id"))), lambda x: x["researcher_id"]).alias("declarers"))
    teams = members.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).join(records, "project_id")
    order = F.struct(F.when(F.col("place") == 1, 0).otherwise(1).alias("a"), (-F.col("n")).alias("b"), "place")
    chosen = teams.groupBy("grp").agg(F.min_by("project_id", order).alias("project_id"))
    team = chosen.join(members, "project_id").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_responsible")).alias("r"), "full_name"))), lambda x: x["full_name"]).alias("team"))
    f = funders.join(records.select("grp", "project_id", "place"), "project_id").select("grp", "place", text("name").alias("name"), funder_nature(F.col("nature")).alias("nature"))
    declared = f.select("grp").distinct()
    first = records.join(declared, "grp", "left_anti").select("grp", "place", text("agency_financier").alias("name"), F.lit(None).cast("string").alias("nature"))
    money = f.unionByName(first).where("name <> ''").withColumn("key", normalized(F.col("name"), upper=True)).groupBy("grp", "key").agg(F.min_by("name", "place").alias("name"), F.array_sort(F.collect_set("nature")).alias("natures"))
    funds = money.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("name", F.array_join("natures", "/").alias("natures")))).alias("funders"))
    rep = g.where("place = 1").select("grp", "id", "name", project_status(F.col("status")).alias("status"), project_nature(F.col("nature")).alias("nature"), project_period(F.col("start_year"), F.col("end_year"), F.col("status")).alias("period"), "records")
    return rep.join(d, "grp", "left").join(who, "grp").join(team, "grp", "left").join(funds, "grp", "left").drop("grp")


def totals(projects: DataFrame) -> DataFrame:
    """Records, groups, groups of several researchers, ongoing records."""
    g = projects.select(F.coalesce(project_key(), F.concat(F.lit("#"), F.col("id").cast("string"))).alias("grp"), "researcher_id", "status")
    per = g.groupBy("grp").agg(F.countDistinct("researcher_id").alias("who"), F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "EM_ANDAMENTO").cast("int")).alias("open"))
    return per.agg(F.sum("n").cast("bigint").alias("records"), F.count(F.lit(1)).alias("groups"), F.sum((F.col("who") > 1).cast("int")).cast("bigint").alias("shared_groups"), F.sum("open").cast("bigint").alias("ongoing"))


def matching(projects: DataFrame, as_of_year: int, name: str = "", status: str = "", nature: str = "", first: int | None = None, last: int | None = None) -> DataFrame:
    """by name, status, nature and years: begun by `last`, and ended, or ongoing, or begun in `first` or later."""
    out = projects
    if name:
        out = out.where(F.contains(fold(F.col("name")), F.lit(fold_text(name))))
    if status:
        out = out.where(F.col("status") == status)
    if nature:
        out = out.where(F.col("nature") == nature)
    end = F.coalesce("end_year", F.when(F.col("status") == "EM_ANDAMENTO", F.lit(as_of_year)).otherwise(F.col("start_year")))
    if last is not None:
        out = out.where(F.col("start_year") <= last)
    if first is not None:
        out = out.where(end >= first)
    return out
