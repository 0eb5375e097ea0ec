"""The thesaurus of authors: identities, the names they go by and their identifiers (inventory R6).

`synced` completes what is stored with the researchers and the authors of the works, and never recreates or joins what is there:

* Identities and variants that are stored, and the researchers, are seeds. A researcher is the identity of that name, else the one that has
  the name as a variant, else a new one. Two seeds are never joined.
* A name key belongs to one identity. Of the researchers' names and citation forms that are new the first claim wins: lower researcher id, the full
  name before citation forms, these in their order.
* An author row (name, citation form) belongs to the seed of the first of its keys that is known: name, citation form, inverted name, inverted citation form. Its
  citation form is then a variant of that identity too, by which further rows belong to it, and so on, round by round; of several claims of a round the lowest identity wins.
* What is left joins by common keys: each component is one new identity.
* An author row that belongs only by an inverted form, which is no variant, has its own name stored as one: another run creates nothing.

The order of rows has no part in it: the original goes through the rows one by one and leaves open which comes first.

New ids go on from the largest stored one, for researchers by their id, then for authors by the component's smallest key; they come from ranges sorted in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import inverted_name, normalized
from ..plans.storage import numbered, stored
from .families import components

#: Longest stored name (fixed value).
NAME_CHARS = 250


def _key(c):
    return F.substring(normalized(F.substring(F.trim(c), 1, NAME_CHARS), upper=True), 1, NAME_CHARS)


def _owners(keys: DataFrame) -> DataFrame:
    """key and the lowest identity that has it."""
    return keys.where("key <> ''").groupBy("key").agg(F.min("identity_id").alias("identity_id"))


def synced(identities: DataFrame, variants: DataFrame, identifiers: DataFrame, researchers: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The completed tables.

    identities: id, preferred_name, normalized_name; variants: id, identity_id, name, normalized_name, source; identifiers: identity_id, provider, identifier; researchers: id,
    full_name, citation_names (between semicolons), orcid; authors: author_name, citation_name. Where stored keys repeat, the identity of the lowest row has them. An identity that has an ORCID
    keeps it. Names without a letter or digit don't count. New variants have no row id.
    """
    known = variants.where("normalized_name <> ''").groupBy(F.col("normalized_name").alias("key")).agg(F.min_by("identity_id", "id").alias("identity_id"))
    by_name = identities.where("normalized_name <> ''").groupBy(F.col("normalized_name").alias("key")).agg(F.min("id").alias("identity_id"))
    largest = identities.agg(F.max("id")).first()[0] or 0

    # 1. Researchers
    r = researchers.where("trim(full_name) <> ''").select("id", F.substring(F.trim("full_name"), 1, NAME_CHARS).alias("name"), F.coalesce("citation_names", F.lit("")).alias("cited"), F.trim(F.coalesce("orcid", F.lit(""))).alias("orcid"))
    r = r.withColumn("key", _key(F.col("name"))).where("key <> ''")
    j = r.join(by_name.withColumnRenamed("identity_id", "own"), "key", "left").join(known.withColumnRenamed("identity_id", "variant_of"), "key", "left")
    fresh = j.where("own IS NULL AND variant_of IS NULL").groupBy("key").agg(F.min("id").alias("first"), F.min_by("name", "id").alias("name"))
    fresh, _ = stored(numbered(fresh, "first", largest, "identity_id"), "new-identities")
    seeded = j.join(fresh.select("key", F.col("identity_id").alias("new")), "key", "left").select("id", "key", "name", "cited", "orcid", F.coalesce("own", "variant_of", "new").alias("identity_id"))
    seeded, _ = stored(seeded, "seeded-researchers")
    largest += fresh.count()
    full = seeded.select("id", F.lit(-1).alias("place"), "key", "name", "identity_id", F.lit("lattes").alias("source"))
    cited = seeded.select("id", "identity_id", F.posexplode(F.split("cited", ";")).alias("place", "name")).select("id", "place", _key(F.col("name")).alias("key"), F.substring(F.trim("name"), 1, NAME_CHARS).alias("name"), "identity_id", F.lit("citation").alias("source"))
    claims = full.unionByName(cited).where("key <> ''").groupBy("key").agg(F.min(F.struct("id", "place", "identity_id", "name", "source")).alias("x")).select("key", "x.identity_id", "x.name", "x.source")
    added, _ = stored(claims.join(known.select("key"), "key", "left_anti").select("identity_id", "name", F.col("key").alias("normalized_name"), "source"), "claims")
    has = identifiers.where("provider = 'orcid'").select("identity_id").distinct()
    orcids = seeded.where("orcid <> ''").groupBy("identity_id").agg(F.min_by("orcid", "id").alias("identifier")).join(has, "identity_id", "left_anti").select("identity_id", F.lit("orcid").alias("provider"), F.substring("identifier", 1, 50).alias("identifier"))

    # 2. Authors that belong to seeds, round by round
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    a = authors.select(text("author_name").alias("n"), text("citation_name").alias("c")).where("n <> '' OR c <> ''").distinct()
    a = a.select(F.substring(F.when(F.col("n") != "", F.col("n")).otherwise(F.col("c")), 1, NAME_CHARS).alias("name"), "c").distinct()
    turned = lambda c: F.when(F.col(c).contains(",") | F.col(c).contains(" "), inverted_name(F.col(c)))
    canonical = F.when(F.col("name").contains(",") & (F.col("k2") != ""), F.substring(inverted_name(F.col("name")), 1, NAME_CHARS)).otherwise(F.col("name"))
    a = a.withColumns({"k0": _key(F.col("name")), "k1": _key(F.col("c")), "k2": F.coalesce(_key(turned("name")), F.lit("")), "k3": F.coalesce(_key(turned("c")), F.lit(""))}).where("k0 <> ''").withColumn("canonical", canonical)
    every, _ = stored(a.withColumn("canonical_key", _key(F.col("canonical"))), "author-rows")
    rows = every
    variant_keys = known.unionByName(added.select(F.col("normalized_name").alias("key"), "identity_id"))
    names = by_name.unionByName(fresh.select("key", "identity_id"))
    # A variant decides before an identity's own name, whatever the key: as steps 0-3 and 4-5.
    owned = _owners(variant_keys).withColumn("own_name", F.lit(0)).unionByName(_owners(names).withColumn("own_name", F.lit(1)))
    asked = lambda df: df.select("name", "c", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("step", "key")).where("key <> ''")
    step = F.when(F.col("own_name") == 1, F.when(F.col("step") == 0, 4).when(F.col("step") == 2, 5)).otherwise(F.col("step"))
    of = rows.limit(0).select("name", "c", F.lit(0).cast("long").alias("identity_id"))
    all_variants = variant_keys
    parts, citations = [of], []
    while True:
        placed = asked(rows).join(owned, "key").withColumn("step", step).where("step IS NOT NULL").groupBy("name", "c").agg(F.min(F.struct("step", "identity_id")).alias("x")).select("name", "c", F.col("x.identity_id").alias("identity_id"))
        placed, _ = stored(placed, "placed")
        if placed.isEmpty():
            break
        parts.append(placed)
        held = rows.join(placed, ["name", "c"])
        new = held.where("k1 <> ''").groupBy("k1").agg(F.min(F.struct("identity_id", "c")).alias("x")).select(F.col("k1").alias("key"), "x.identity_id", F.substring("x.c", 1, NAME_CHARS).alias("name"))
        new, _ = stored(new.join(all_variants.select("key"), "key", "left_anti"), "citations")
        citations.append(new.select("identity_id", "name", F.col("key").alias("normalized_name"), F.lit("citation").alias("source")))
        turned_keys = held.join(new.select(F.col("key").alias("k1")), "k1", "left_semi").where("k3 <> ''").select(F.col("k3").alias("key"), "identity_id")
        fresh_keys = _owners(new.select("key", "identity_id").unionByName(turned_keys)).join(all_variants.select("key"), "key", "left_anti")
        fresh_keys, _ = stored(fresh_keys, "fresh-keys")
        all_variants = all_variants.unionByName(fresh_keys)
        rows, _ = stored(rows.join(placed.select("name", "c"), ["name", "c"], "left_anti"), "author-rows")
        owned = fresh_keys.withColumn("own_name", F.lit(0))

    # 3. Authors of no seed: components of common keys
    keys = rows.select(F.explode(F.array_distinct(F.array("k1", "k2", "k3", "canonical_key"))).alias("b"), F.col("k0").alias("a")).where("b <> ''")
    c = components(keys)
    left = rows.join(c.select(F.col("node").alias("k0"), "root"), "k0")
    groups = left.groupBy("root").agg(F.min(F.struct("canonical_key", "canonical")).alias("x")).select("root", F.col("x.canonical").alias("name"), F.col("x.canonical_key").alias("key"))
    groups, _ = stored(numbered(groups, "root", largest, "identity_id"), "author-identities")
    own = groups.select("identity_id", "name", F.col("key").alias("normalized_name"), F.lit("production").alias("source"))
    said = left.where("k1 <> ''").groupBy("root", "k1").agg(F.min("c").alias("c")).join(groups, "root").where("k1 <> key").select("identity_id", F.substring("c", 1, NAME_CHARS).alias("name"), F.col("k1").alias("normalized_name"), F.lit("citation").alias("source"))

    # 4. Rows that belong by an inverted form that isn't stored, so that another run finds them again
    belongs = left.select("name", "c", "root").join(groups.select("root", "identity_id"), "root").select("name", "c", "identity_id")
    for x in parts:
        belongs = belongs.unionByName(x)
    new_variants = added
    for x in [*citations, own, said]:
        new_variants = new_variants.unionByName(x)
    new_variants, _ = stored(new_variants, "new-variants")
    found = known.select("key").unionByName(new_variants.select(F.col("normalized_name").alias("key"))).distinct()
    again = asked(every).join(found, "key", "left_semi").select("name", "c")
    called = by_name.select("key").unionByName(fresh.select("key")).unionByName(groups.select("key")).distinct()
    by_own = every.select("name", "c", F.explode(F.array("k0", "k2")).alias("key")).join(called, "key", "left_semi").select("name", "c")
    lost = every.join(again.unionByName(by_own).distinct(), ["name", "c"], "left_anti").join(belongs, ["name", "c"])
    lost = lost.groupBy("k0").agg(F.min(F.struct("identity_id", "name")).alias("x")).select("x.identity_id", "x.name", F.col("k0").alias("normalized_name"), F.lit("production").alias("source"))

    new_identities = fresh.select(F.col("identity_id").alias("id"), F.col("name").alias("preferred_name"), F.col("key").alias("normalized_name")).unionByName(groups.select(F.col("identity_id").alias("id"), F.col("name").alias("preferred_name"), F.col("key").alias("normalized_name")))
    new_variants = new_variants.unionByName(lost).select(F.lit(None).cast(variants.schema["id"].dataType).alias("id"), "identity_id", "name", "normalized_name", "source")
    return identities.select("id", "preferred_name", "normalized_name").unionByName(new_identities), variants.select("id", "identity_id", "name", "normalized_name", "source").unionByName(new_variants), identifiers.select("identity_id", "provider", "identifier").unionByName(orcids)
