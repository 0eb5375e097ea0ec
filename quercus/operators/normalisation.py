"""Normalisation of curricula: works, authors, institutions and the own affiliation of every researcher (inventory B25).

The distinct names of journals, authors and institutions are resolved first, each once. What belongs to a researcher then follows from the own rows
and these names. A later run resolves the distinct names again and compares: only researchers whose own rows changed, or who have a name that
leads elsewhere now, are made anew; the others' rows stay as they are stored. The result is that of a full run.

A researcher's rows are known by the sum of their 64-bit hashes and their number, for each table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.storage import stored
from . import entities, journals as jn

Tables = dict[str, DataFrame]
#: Tables of inputs and the column that names the researcher.
OWNERS = {"researchers": "id", "items": "researcher_id", "authors": "researcher_id", "educations": "researcher_id", "experiences": "researcher_id"}
# Words of a role or contract that is no career, and the first year that counts.
TEMPORARY = "substituto|aluno|bolsista|estagi|temporário"
FIRST_YEAR = 1960


def names(inputs: Tables, lookups: Tables) -> Tables:
    """What every distinct name leads to: journals (with stratum and databases), authors, institutions.

    inputs: items (id, researcher_id, item_type, journal_name, issn), authors (id, researcher_id, author_name, citation_name), educations and experiences (id, researcher_id, institution_name, ...),
    researchers. lookups: journals, variants (journal_id, name), links, people (id, name), author_variants (name, identity_id), identities (id, preferred_name), institutions (id, name).
    """
    articles = inputs["items"].where("item_type = 'ARTIGO' AND (journal_name <> '' OR issn <> '')").select(F.col("journal_name").alias("name"), "issn")
    j = jn.resolve(articles, lookups["journals"], lookups.get("variants")).select("name", "issn", "journal_id")
    strata = jn.shown_stratum(lookups["journals"]).select(F.col("id").alias("journal_id"), "qualis")
    bases = lookups["links"].groupBy("journal_id").agg(F.array_sort(F.collect_set("database_id")).alias("databases"))
    a = inputs["authors"]
    called = a.select(F.trim("citation_name").alias("name")).unionByName(a.select(F.trim("author_name").alias("name"))).where("name <> ''").distinct()
    places = inputs["educations"].select(F.col("institution_name").alias("name")).unionByName(inputs["experiences"].select(F.col("institution_name").alias("name"))).where("name <> ''").distinct()
    return {
        "journals": j.join(strata, "journal_id", "left").join(bases, "journal_id", "left").select("name", "issn", "journal_id", "qualis", "databases"),
        "authors": entities.match_authors(called, lookups["people"], lookups.get("author_variants"), lookups["identities"]).select("name", "researcher_id", "identity_id"),
        "institutions": entities.match_institutions(places, lookups["institutions"]).select("name", "institution_id"),
    }


def affiliation(researchers: DataFrame, experiences: DataFrame, own: str, year: int) -> DataFrame:
    """id, admission_year, leave_year, status of researchers by their bonds with the own institution, whose name has the pattern `own`.

    Admission is only filled where it is empty: the first year of a bond that isn't temporary. With a bond that goes on (current, without end, or ending this year or later) the researcher is active, and a
    leave year that is over goes; with ended ones alone inactive since the last of them, unless a leave year that is over is there; without any all stays.
    """
    e = experiences.where(F.lower("institution_name").rlike(own))
    lasting = ~F.coalesce(F.lower(F.concat_ws(" ", "role_name", "contract_type")), F.lit("")).rlike(TEMPORARY)
    open_ = F.col("is_current") | F.col("end_year").isNull() | (F.col("end_year") >= year)
    g = e.groupBy(F.col("researcher_id").alias("id")).agg(
        F.min(F.when(lasting & (F.col("start_year") > FIRST_YEAR) & (F.col("start_year") <= year), F.col("start_year"))).alias("first"), F.max(F.coalesce(open_, F.lit(False))).alias("open"),
        F.max(F.when(~F.coalesce(open_, F.lit(False)) & (F.col("end_year") > FIRST_YEAR) & (F.col("end_year") < year), F.col("end_year"))).alias("last"),
    )
    j = researchers.select("id", "admission_year", "leave_year", "status").join(g, "id", "left")
    leave, over = F.nullif("leave_year", F.lit(0)), F.coalesce("open", F.lit(False))
    return j.select(
        "id", F.coalesce(F.nullif("admission_year", F.lit(0)), "first", "admission_year").alias("admission_year"),
        F.when(over, F.when(F.col("leave_year") < year, None).otherwise(F.col("leave_year"))).when(F.col("last").isNotNull() & (leave.isNull() | (leave >= year)), F.col("last")).otherwise(F.col("leave_year")).alias("leave_year"),
        F.when(over, 1).when(F.col("last").isNotNull(), 0).otherwise(F.col("status")).cast("int").alias("status"),
    )


def _made(inputs: Tables, found: Tables, own: str, year: int) -> Tables:
    items = inputs["items"].select("id", "researcher_id", "item_type", "journal_name", "issn")
    j = found["journals"].select(F.col("name").alias("__n"), F.col("issn").alias("__i"), "journal_id", "qualis", "databases")
    hit = items["journal_name"].eqNullSafe(j["__n"]) & items["issn"].eqNullSafe(j["__i"]) & (items["item_type"] == "ARTIGO")
    works = items.join(j, hit, "left").select("id", "researcher_id", F.nullif(fold("journal_name"), F.lit("")).alias("journal_name_normalized"), F.col("journal_id").alias("qualis_journal_id"), "qualis", "databases")
    a = inputs["authors"].select("id", "researcher_id", F.trim(F.coalesce("citation_name", F.lit(""))).alias("c"), F.trim(F.coalesce("author_name", F.lit(""))).alias("n"))
    by = lambda key, x: found["authors"].select(F.col("name").alias(key), F.struct(F.col("researcher_id").alias("r"), F.col("identity_id").alias("i")).alias(x)).where(F.col(f"{x}.r").isNotNull() | F.col(f"{x}.i").isNotNull())
    who = a.join(by("c", "x"), "c", "left").join(by("n", "y"), "n", "left").withColumn("w", F.coalesce("x", "y"))
    people = who.select("id", "researcher_id", F.col("w.i").alias("identity_id"), F.col("w.r").alias("matched_researcher_id"), F.col("w.r").isNotNull().alias("is_own"))
    at = found["institutions"].select(F.col("name").alias("institution_name"), "institution_id")
    places = {t: inputs[t].select("id", "researcher_id", "institution_name").join(at, "institution_name", "left").select("id", "researcher_id", "institution_id") for t in ("educations", "experiences")}
    return {"items": works, "authors": people, **places, "researchers": affiliation(inputs["researchers"], inputs["experiences"], own, year)}


def _prints(inputs: Tables) -> DataFrame:
    """owner, and the state of the owner's rows in every table."""
    parts = [df.groupBy(F.col(OWNERS[t]).alias("owner"), F.lit(t).alias("t")).agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")) for t, df in inputs.items() if t in OWNERS]
    rows = reduce(DataFrame.unionByName, parts).where("owner IS NOT NULL")
    return rows.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("t", "h", "n"))).alias("print"))  # five at most


def _changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose row isn't the same in both, or is in one alone."""
    rest = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*rest).alias(name))
    a, b = side(old, "a"), side(new, "b")
    same: Column = reduce(lambda x, y: x & y, (a[f"a_{k}"].eqNullSafe(b[f"b_{k}"]) for k in keys))
    j = a.join(b, same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys)).distinct()


def normalised(inputs: Tables, lookups: Tables, own: str, year: int) -> tuple[Tables, Tables]:
    """The outputs by table, and the state that `renormalised` asks for: stored names and prints."""
    found = {n: stored(df, f"names-{n}")[0] for n, df in names(inputs, lookups).items()}
    prints, _ = stored(_prints(inputs), "prints")
    return _made(inputs, found, own, year), found | {"prints": prints}


def renormalised(outputs: Tables, state: Tables, inputs: Tables, lookups: Tables, own: str, year: int) -> tuple[Tables, Tables, DataFrame]:
    """B25 after changes: the outputs, the new state, and the researchers (owner) that were made anew. own and year have to be those of the state."""
    found = {n: stored(df, f"names-{n}")[0] for n, df in names(inputs, lookups).items()}
    prints, _ = stored(_prints(inputs), "prints")
    j, a, p = (_changed(state[n], found[n], k) for n, k in (("journals", ["name", "issn"]), ("authors", ["name"]), ("institutions", ["name"])))
    i = inputs["items"].where("item_type = 'ARTIGO'")
    hit = i["journal_name"].eqNullSafe(j["name"]) & i["issn"].eqNullSafe(j["issn"])
    owners = [_changed(state["prints"], prints, ["owner"]), i.join(j, hit, "left_semi").select(F.col("researcher_id").alias("owner"))]
    called = inputs["authors"].select("researcher_id", F.explode(F.array(F.trim("citation_name"), F.trim("author_name"))).alias("name"))
    owners.append(called.join(a, "name", "left_semi").select(F.col("researcher_id").alias("owner")))
    owners += [inputs[t].join(p.select(F.col("name").alias("institution_name")), "institution_name", "left_semi").select(F.col("researcher_id").alias("owner")) for t in ("educations", "experiences")]
    again, _ = stored(reduce(DataFrame.unionByName, owners).where("owner IS NOT NULL").distinct(), "changed-owners")
    mine = lambda df, t: df.join(again.select(F.col("owner").alias(OWNERS[t])), OWNERS[t], "left_semi")
    fresh = _made({t: mine(df, t) if t in OWNERS else df for t, df in inputs.items()}, found, own, year)
    kept = {t: df.join(again.select(F.col("owner").alias(OWNERS[t])), OWNERS[t], "left_anti") for t, df in outputs.items()}
    return {t: kept[t].select(*fresh[t].columns).unionByName(fresh[t]) for t in fresh}, found | {"prints": prints}, again
