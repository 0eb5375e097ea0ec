"""Merges, upserts, comparisons and resolution of names (inventory J8-J12, Z8, B21-B23, B29, B30, A61, A63, R5, R7, S22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inverted_name, issns, normalized, resolver_key, without_parentheses
from .curation import is_name, prefix_match
from .merges import roots


def fill_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert: rows of old keep what they have, empty fields are filled, unknown keys are added."""
    n = new.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    j = old.select(key, *columns).join(n, old[key] == n["__k"], "full_outer")
    return j.select(F.coalesce(key, "__k").alias(key), *(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) for c in columns))


# The longest title and stratum that an imported row may have.
TITLE_CHARS, STRATUM_CHARS = 500, 10


def _name_keys(journals: DataFrame) -> DataFrame:
    """key, id (the lowest), family and whether several families have the key. journals: id, title, canonical_journal_id."""
    j = journals.select("id", F.coalesce("canonical_journal_id", "id").alias("fid"), resolver_key(F.col("title")).alias("key")).where("key <> ''")
    return j.groupBy("key").agg(F.min("id").alias("hit"), (F.min("fid") != F.max("fid")).alias("several"))


def _issn_keys(journals: DataFrame, *columns: str) -> DataFrame:
    """issn and the lowest row that has it in one of the columns."""
    return journals.select("id", F.explode(issns(F.concat_ws(" ", *columns))).alias("k")).groupBy("k").agg(F.min("id").alias("hit"))


def _by_number(rows: DataFrame, known: DataFrame) -> DataFrame:
    """n and the row of the first ISSN, in order, that the catalogue knows. rows: n, numbers."""
    return rows.select("n", F.posexplode("numbers").alias("pos", "k")).join(known, "k").groupBy("n").agg(F.min(F.struct("pos", "hit")).alias("x")).select("n", F.col("x.hit").alias("by_number"))


def import_journals(journals: DataFrame, rows: DataFrame) -> DataFrame:
    """N, state and journal_id of each imported row, and what it fills.

    A row needs a title of at most 500 characters and a stratum of at most 10, else it is invalid; one without any field is left out. It is matched by
    ISSN, by title only if it has none: an unknown ISSN is a new journal. A title of several families is ambiguous. Families locked by hand
    stay. A matched row fills only what is empty; of new rows of one ISSN, or of one title without ISSN, the first makes the journal and the others complete it.
    journals: id, title, issn, qualis, area, canonical_journal_id, areas_locked; rows: n, title, issn, qualis, area.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    r = rows.select("n", text("title").alias("title"), text("issn").alias("issn"), F.upper(text("qualis")).alias("qualis"), text("area").alias("area")).where(F.concat("title", "issn", "qualis", "area") != "")
    r = r.withColumns({"numbers": issns(F.col("issn")), "key": resolver_key(F.col("title")), "bad": (F.col("title") == "") | (F.length("title") > TITLE_CHARS) | (F.length("qualis") > STRATUM_CHARS)})
    names = _name_keys(journals)
    found = r.join(_by_number(r, _issn_keys(journals, "issn")), "n", "left").join(names, "key", "left")
    by_title = F.col("issn") == ""
    hit = F.coalesce("by_number", F.when(by_title & ~F.col("several"), F.col("hit")))
    j = journals.select(F.col("id").alias("journal_id"), F.coalesce("canonical_journal_id", "id").alias("fid"), *(F.coalesce(c, F.lit("")).alias(f"was_{c}") for c in ("issn", "qualis", "area")))
    locked = journals.where("areas_locked").select(F.coalesce("canonical_journal_id", "id").alias("fid"), F.lit(True).alias("locked")).distinct()
    m = found.withColumn("journal_id", hit).join(j, "journal_id", "left").join(locked, "fid", "left")
    fills = {c: (F.col(f"was_{c}") == "") & (F.col(c) != "") for c in ("issn", "qualis", "area")}
    group = F.coalesce(F.get("numbers", 0), F.nullif("issn", F.lit("")), F.concat(F.lit("t:"), "key"))
    w = Window.partitionBy(F.when(F.col("journal_id").isNull() & ~F.col("bad"), group).otherwise(F.concat(F.lit("#"), F.col("n").cast("string")))).orderBy("n")
    state = (
        F.when(F.col("bad"), "invalid").when(F.col("by_number").isNull() & by_title & F.coalesce("several", F.lit(False)), "ambiguous").when(F.col("journal_id").isNull(), F.when(F.row_number().over(w) == 1, "created").otherwise("completed"))
        .when(F.coalesce("locked", F.lit(False)), "locked").when(fills["issn"] | fills["qualis"] | fills["area"], "completed").otherwise("unchanged")
    )
    out = m.withColumn("state", state)
    done = F.col("state") == "completed"
    return out.select("n", "state", "journal_id", *(F.when((F.col("state") == "created") | done & F.coalesce(f, F.lit(True)), F.nullif(c, F.lit(""))).alias(c) for c, f in fills.items()))


def upsert_titles(journals: DataFrame, rows: DataFrame) -> DataFrame:
    """N, state (updated, inserted, ambiguous) and journal_id of each row of a title list; unlike S22 the title is tried even when the ISSN is unknown.

    By the first of printed, electronic, linking and plain ISSN that the catalogue knows in any of its columns, else by the whole title, else by the title without
    parentheses; a title of several families is ambiguous. journals: id, title, issn, issn_imp, issn_e, issn_l, canonical_journal_id; rows: n and the columns of `lists.title_list`.
    """
    r = rows.select("n", "title", issns(F.concat_ws(" ", "issn_imp", "issn_e", "issn_l", "issn")).alias("numbers"), resolver_key(F.coalesce("title", F.lit(""))).alias("key"), resolver_key(without_parentheses(F.coalesce("title", F.lit("")))).alias("bare"))
    names = _name_keys(journals)
    found = r.join(_by_number(r, _issn_keys(journals, "issn", "issn_imp", "issn_e", "issn_l")), "n", "left").join(names, "key", "left").join(names.select(F.col("key").alias("bare"), F.col("hit").alias("hit2"), F.col("several").alias("several2")), "bare", "left")
    several = F.when(F.col("hit").isNotNull(), F.col("several")).otherwise(F.coalesce("several2", F.lit(False)))
    hit = F.coalesce("by_number", F.when(~several, F.coalesce("hit", "hit2")))
    state = F.when(F.col("by_number").isNull() & several, "ambiguous").when(hit.isNull(), "inserted").otherwise("updated")
    return found.select("n", state.alias("state"), hit.alias("journal_id"))


def new_variants(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of each row's journal the variations that no family knows yet, once a key; a name of another family is a conflict, one of its own is skipped.

    rows: fid, variations (array); known: key, fid. Names under two letters, without key or that are no names don't count.
    """
    v = rows.select("fid", F.explode("variations").alias("name")).select("fid", F.trim("name").alias("name"), resolver_key(F.col("name")).alias("key")).where((F.length("name") >= 2) & (F.col("key") != "") & is_name(F.col("name")))
    first = v.groupBy("key").agg(F.min(F.struct("fid", "name")).alias("x"), F.max("fid").alias("last"))
    owners = known.groupBy("key").agg(F.min("fid").alias("owner"))
    state = F.when(F.col("owner").isNull(), F.when(F.col("x.fid") == F.col("last"), "added").otherwise("conflict")).when((F.col("owner") == F.col("x.fid")) & (F.col("owner") == F.col("last")), "skipped").otherwise("conflict")
    return first.join(owners, "key", "left").select(F.col("x.fid").alias("fid"), F.col("x.name").alias("name"), state.alias("state"))


def remapped(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Ids of merged entities become those they were merged into, in the end. merges: old, new."""
    m = roots(merges).withColumnRenamed("old", column)
    return df.join(m, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def deduplicated(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Of rows equal in keys that of the smallest id."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col))


def new_items(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after whose key before doesn't have; nulls equal nulls."""
    cond = None
    b = before.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    for k in keys:
        c = after[k].eqNullSafe(b[f"__{k}"])
        cond = c if cond is None else cond & c
    return after.join(b, cond, "left_anti")


def replaced(old: DataFrame, new: DataFrame, owner: str, keep) -> DataFrame:
    """The rows of owners that come anew are replaced, but for those that `keep` says to keep."""
    owners = new.select(owner).distinct()
    kept = old.join(owners, owner, "left_anti").unionByName(old.where(keep).join(owners, owner, "left_semi"))
    return kept.unionByName(new)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Same, changed, gained, lost, new or removed links between two snapshots. Both: id, journal_id."""
    j = before.select("id", F.col("journal_id").alias("b"), F.lit(1).alias("x")).join(after.select("id", F.col("journal_id").alias("a"), F.lit(1).alias("y")), "id", "full_outer")
    state = (
        F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").when(F.col("b").isNull(), "gained").when(F.col("a").isNull(), "lost").otherwise("changed")
    )
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def review_page(queue: DataFrame, contains: str, column: str, order: str, id_col: str, page: int, size: int) -> DataFrame:
    """A page of a review queue, most frequent first, then id."""
    hits = queue.where(F.contains(normalized(F.col(column)), F.lit(contains)))
    return hits.orderBy(F.desc(order), id_col).offset((max(1, page) - 1) * size).limit(size)


def name_forms(c) -> F.Column:
    """The keys under which a person's name is looked up, in order: as it is, without points and commas, inverted, and that without them. One case stands for both."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[.,;]", " "), r"\s+", " "))
    own, other = normalized(c), F.when(F.contains(F.trim(c), F.lit(" ")) | F.contains(c, F.lit(",")), normalized(inverted_name(c)))
    return F.array_distinct(F.filter(F.array(own, plain(own), other, plain(other)), lambda k: k.isNotNull() & (k != "")))


def match_authors(names: DataFrame, people: DataFrame, variants: DataFrame | None = None, identities: DataFrame | None = None) -> DataFrame:
    """Researcher and identity of each distinct name: by the forms of the researchers' names first, then by active variants, then by active identities.

    The first form that is known decides; of several researchers under a key the last id, of several identities the lowest. An identity whose preferred name is a
    researcher's gives that one too. Names under two characters match nothing. people: id, name (a row for each full and citation name); variants: name, identity_id;
    identities: id, preferred_name.
    """
    keyed = lambda df, i, c: df.select(i, F.explode(name_forms(F.col(c))).alias("key"))
    own = keyed(people, "id", "name").groupBy("key").agg(F.max("id").alias("researcher_id"))
    n = names.select("name").distinct()
    forms = n.where(F.length(F.trim("name")) >= 2).select("name", F.posexplode(name_forms(F.col("name"))).alias("step", "key"))
    hits = forms.join(own, "key").groupBy("name").agg(F.min_by("researcher_id", "step").alias("researcher_id"))
    out = n.join(hits, "name", "left")
    if identities is None:
        return out
    rest = forms.join(hits, "name", "left_anti")
    keys = identities.select(F.col("id").alias("identity_id"), normalized(F.col("preferred_name")).alias("key")).select("key", "identity_id", F.lit(1).alias("stage"))
    if variants is not None:
        active = variants.join(identities.select(F.col("id").alias("identity_id")), "identity_id", "left_semi")
        keys = keys.unionByName(active.select(normalized(F.col("name")).alias("key"), "identity_id", F.lit(0).alias("stage")))
    found = rest.join(keys.where("key <> ''"), "key").groupBy("name").agg(F.min(F.struct("stage", "identity_id")).alias("x")).select("name", F.col("x.identity_id").alias("identity_id"))
    preferred = identities.select(F.col("id").alias("identity_id"), normalized(F.col("preferred_name")).alias("key")).join(own, "key", "left").select("identity_id", F.col("researcher_id").alias("also"))
    j = out.join(found.join(preferred, "identity_id", "left"), "name", "left")
    return j.select("name", F.coalesce("researcher_id", "also").alias("researcher_id"), "identity_id")


def merged_journals(journals: DataFrame, merges: DataFrame, links: DataFrame, variants: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Journals, links, variants and evidence after rows were merged into others: empty fields of the kept row are filled from the merged ones, lowest id first; what
    hung on a merged row hangs on the kept one, once; a merged title becomes a variant; of equal evidence (source, record, label) the lowest id stays.

    journals: id, title, issn, qualis, canonical_journal_id; merges: old, new (new is kept); links: journal_id, database_id; variants: journal_id, name; evidence: id, journal_id, source, record_key, label.
    """
    merges = roots(merges)
    old = journals.join(merges.withColumnRenamed("old", "id"), "id")
    fill = old.groupBy(F.col("new").alias("id")).agg(*(F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(None)).isNotNull(), F.col("id"))).alias(f"__{c}") for c in ("issn", "qualis")))
    j = journals.join(merges.select(F.col("old").alias("id")), "id", "left_anti").join(fill, "id", "left")
    j = j.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in ("issn", "qualis")}).drop("__issn", "__qualis")
    moved = remapped(j, "canonical_journal_id", merges)
    moved = moved.withColumn("canonical_journal_id", F.when(F.col("canonical_journal_id") != F.col("id"), F.col("canonical_journal_id"))).select(*journals.columns)
    titles = old.select(F.col("new").alias("journal_id"), F.col("title").alias("name"))
    names = remapped(variants, "journal_id", merges).select("journal_id", "name").unionByName(titles).withColumn("key", resolver_key(F.col("name"))).where("key <> ''")
    own = moved.select(F.col("id").alias("journal_id"), resolver_key(F.col("title")).alias("key"))
    names = names.join(own, ["journal_id", "key"], "left_anti").groupBy("key").agg(F.min(F.struct("journal_id", "name")).alias("x")).select("x.journal_id", "x.name")
    e = remapped(evidence, "journal_id", merges)
    e = e.join(deduplicated(e, ["journal_id", "source", "record_key", "label"]).select("id"), "id", "left_semi")
    return moved, remapped(links, "journal_id", merges).select("journal_id", "database_id").distinct(), names, e.select(*evidence.columns)


def match_institutions(names: DataFrame, institutions: DataFrame) -> DataFrame:
    """Exact key among all names of an institution, else the key of a part between hyphens, else J11's prefixes, both ways; the lowest id. institutions: id, name."""
    keys = institutions.select(normalized(F.col("name")).alias("key"), "id").where("key <> ''").groupBy("key").agg(F.min("id").alias("id"))
    n = names.select("name").distinct()
    forms = n.select("name", F.posexplode(F.concat(F.array("name"), F.split("name", "-"))).alias("step", "form")).select("name", "step", normalized(F.col("form")).alias("key"))
    hits = forms.join(keys, "key").groupBy("name").agg(F.min(F.struct("step", "id")).alias("x"))
    by_prefix = prefix_match(n.join(hits, "name", "left_anti"), institutions)
    found = hits.select("name", F.col("x.id").alias("institution_id")).unionByName(by_prefix)
    return n.join(found, "name", "left").select("name", "institution_id")
