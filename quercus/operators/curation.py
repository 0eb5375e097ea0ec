"""Curation steps (inventory A44, A62, B10, B13, B14, B17, B19, B20, B28, B31, B32, F14, F15, J8, J11, N22, N28, N30, N31, R4, R8-R10, S6, X7, X8, Z10, Z11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import name_score
from ..functions.text import fold, keyword_key, normalized, resolver_key, topic_key
from ..plans.storage import numbered
from .figures import share

# Tags of technical works and their types.
TECHNICAL_TAGS = {"SOFTWARE": "SOFTWARE", "PATENTE": "PATENTE", "MARCA": "MARCA"}
# What no name of a journal looks like. Lower-case markup and declarations, braces, properties and declarations of style sheets, their
# selectors and comments, frames of a stack trace, and lines of a server's answer. "<Freiburg, Breisgau>" and "#PerDebate" are names.
NOT_A_NAME = [r"</?[a-z][a-z0-9]*(\s[^>]*)?>", r"<!", r"[{}]", r"^--[a-z-]+\s*:", r":\s*[^;]*;\s*$", r"^\.[a-z][\w-]*[\s,.:]", r"^#\d+\s+/", r"/vendor/", r"^/\*", r"^HTTP \d{3}\b"]


def technical_type(tag: Column) -> Column:
    """The type of a technical work's tag."""
    out = F.lit("TRABALHO_TECNICO")
    for k, v in TECHNICAL_TAGS.items():
        out = F.when(tag == k, v).otherwise(out)
    return F.when(tag == "DEMAIS-TIPOS-DE-PRODUCAO-TECNICA", "OUTRA_TECNICA").otherwise(out)


def flag(code: Column) -> Column:
    """The two regional letters of a country code."""
    letter = lambda i: F.decode(F.concat(F.unhex(F.lit("F09F87")), F.unhex(F.hex(F.ascii(F.substring(code, i, 1)) + 101))), "UTF-8")
    return F.when(F.length(code) == 2, F.concat(letter(1), letter(2)))


def is_name(c: Column) -> Column:
    """Has a letter or digit and isn't code: markup, style sheets, traces, answers of a server."""
    name = F.trim(c)
    return name.rlike(r"[\p{L}\p{N}]") & ~name.rlike("|".join(NOT_A_NAME))


def shown_institution(official: Column, acronym: Column) -> Column:
    """Acronym and official name, unless one is in the other."""
    return F.when((F.coalesce(acronym, F.lit("")) != "") & ~F.contains(official, acronym), F.concat_ws(" - ", acronym, official)).otherwise(official)


def database_profile(items: DataFrame) -> DataFrame:
    """Of each researcher the articles by database of their JSON array, and their share of all articles and of those with a database."""
    a = items.where("item_type = 'ARTIGO'").select("researcher_id", "id", "year", F.from_json("indexed_databases", "array<struct<acronym:string>>").alias("d"))
    n = a.select("researcher_id", F.explode("d").alias("d")).groupBy("researcher_id", F.col("d.acronym").alias("acronym")).agg(F.count(F.lit(1)).alias("items"))
    t = a.groupBy("researcher_id").agg(F.count(F.lit(1)).alias("every"), F.sum((F.size("d") > 0).cast("int")).alias("indexed"))
    return n.join(t, "researcher_id").select("researcher_id", "acronym", "items", share(F.col("items"), F.col("every")).alias("percent"), share(F.col("items"), F.col("indexed")).alias("indexed_percent"))


def database_timeline(items: DataFrame, researcher_id: int) -> DataFrame:
    """One researcher's articles by database and year, from the first to the last year of any production, zero-filled."""
    mine = items.where(F.col("researcher_id") == researcher_id)
    d = mine.where("item_type = 'ARTIGO'").select("year", F.explode(F.from_json("indexed_databases", "array<struct<acronym:string>>")).alias("d")).select("year", F.col("d.acronym").alias("acronym"))
    years = mine.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    grid = years.crossJoin(d.select("acronym").distinct())  # years of one researcher times databases
    n = d.where("year IS NOT NULL").groupBy("year", "acronym").agg(F.count(F.lit(1)).alias("items"))
    return grid.join(n, ["year", "acronym"], "left").fillna(0, ["items"])


def source_country(rows: DataFrame, names: DataFrame, codes: DataFrame, marc: dict[str, str], subdivisions: dict[str, str], ambiguous: list[str]) -> DataFrame:
    """Rows (source, raw, ...) with the country's code as each source writes it.

    DOAJ and Latindex give names; OpenAlex mostly ISO codes, but also MARC ones: three letters are a subdivision, told by the last letter; two letters that are one
    thing in some records and another in others count as unknown; other sources tell nothing. names: key (N1), code; codes: code; the rest are the caller's short tables.
    """
    table = lambda c, d: F.try_element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), c) if d else F.lit(None).cast("string")
    code = F.upper(F.trim("raw"))
    two = F.when(code.rlike("^[A-Z]{2}$") & ~code.isin(*ambiguous), F.coalesce(table(code, marc), code))
    r = rows.withColumns({"__name": F.when(F.col("source").isin("doaj", "latindex"), normalized(F.col("raw"))), "__two": F.when(F.col("source") == "openalex", two), "__three": F.when((F.col("source") == "openalex") & code.rlike("^[A-Z]{3}$"), table(F.substring(code, 3, 1), subdivisions))})
    known = codes.select(F.col("code").alias("__two"), F.lit(True).alias("__known"))
    j = r.join(names.select(F.col("key").alias("__name"), F.col("code").alias("__code")), "__name", "left").join(known, "__two", "left")
    return j.withColumn("country", F.coalesce("__code", "__three", F.when(F.col("__known"), F.col("__two")))).drop("__name", "__two", "__three", "__code", "__known")


def refreshed(df: DataFrame, lookup: DataFrame, key: str, column: str) -> tuple[DataFrame, Column]:
    """Column as the lookup has it, and the rows that this changes (nulls equal nulls)."""
    j = df.join(lookup.withColumnRenamed(column, "__new"), key, "left")
    return j.withColumn("changed", ~F.col(column).eqNullSafe(F.col("__new"))).withColumn(column, F.col("__new")).drop("__new"), F.col("changed")


def prefix_match(names: DataFrame, institutions: DataFrame, least: int = 5) -> DataFrame:
    """Names to the first institution, by id, one of whose keys begins the name or is begun by it.

    Both directions are equi-joins of whole prefixes at the lengths that the other side has, each with one row a key, so no
    pair of a name and an institution is made. names: name; institutions: id, name.
    """
    n = names.select("name", normalized(F.col("name")).alias("k")).distinct().where(F.length("k") >= least)
    i = institutions.select("id", normalized(F.col("name")).alias("key")).where(F.length("key") >= least).groupBy("key").agg(F.min("id").alias("id"))
    k = n.select("k").distinct()
    lengths = lambda df, c: df.agg(F.collect_set(F.length(c)).alias("lengths"))
    prefixes = lambda c: F.explode(F.transform(F.filter("lengths", lambda m: m <= F.length(c)), lambda m: F.substring(F.col(c), F.lit(1), m)))
    begun = k.crossJoin(lengths(i, "key")).select("k", prefixes("k").alias("key")).join(i, "key").select("k", "id")
    longer = i.crossJoin(lengths(k, "k")).select("id", prefixes("key").alias("k")).groupBy("k").agg(F.min("id").alias("id")).join(k, "k").select("k", "id")
    first = begun.unionByName(longer).groupBy("k").agg(F.min("id").alias("institution_id"))
    return n.join(first, "k").select("name", "institution_id")


def matched_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Row, researcher: by 16-digit ids and ORCIDs; by names only where neither gives a hit. rows: id, ids, orcids, names (arrays); people: id, registry, orcid, name."""
    p = people.withColumnRenamed("id", "researcher_id")
    by = lambda c, k: rows.select("id", F.explode(c).alias("v")).join(p.select("researcher_id", F.col(k).alias("v")), "v").select("id", "researcher_id")
    sure = by("ids", "registry").unionByName(by("orcids", "orcid")).distinct()
    rest = rows.join(sure.select("id").distinct(), "id", "left_anti")
    named = rest.select("id", F.explode("names").alias("n")).select("id", normalized(F.col("n")).alias("v")).join(p.select("researcher_id", normalized(F.col("name")).alias("v")), "v").select("id", "researcher_id")
    return sure.unionByName(named).distinct()


def title_rules(journals: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Areas whose pattern a title holds, with weights that add up to 1. The rules are a short list of the caller's."""
    hits = F.filter(F.array(*(F.when(F.col("k").rlike(p), F.lit(s)) for p, s in rules)), lambda x: x.isNotNull())
    j = journals.select("id", normalized(F.col("title")).alias("k")).select("id", F.array_distinct(hits).alias("slugs")).where(F.size("slugs") > 0)
    return j.select("id", F.posexplode("slugs").alias("i", "slug"), F.size("slugs").alias("n")).select("id", "slug", ((F.floor(F.lit(10000) / F.col("n")) + (F.col("i") < F.lit(10000) % F.col("n")).cast("int")) / 10000).cast("decimal(6,4)").alias("weight"))


def external_names(records: DataFrame, known: DataFrame, titles: DataFrame) -> DataFrame:
    """Names of external records that no key has yet and that lead to one family: taken with a score of 0.6 or more, from two sources,
    or if name and title lie one in the other by words and one of these is rare: of 5 letters or more, in at most 5 titles.

    records: src, name, fid; known: key; titles: fid, title.
    """
    r = records.select("src", "name", "fid", resolver_key(F.col("name")).alias("key")).where("key <> ''").join(known.select("key").distinct(), "key", "left_anti")
    one = r.groupBy("key").agg(F.min("fid").alias("fid"), F.max("fid").alias("other"), F.countDistinct("src").alias("sources"), F.min("name").alias("name")).where("fid = other").drop("other")
    t = titles.select("fid", resolver_key(F.col("title")).alias("t"))
    pairs = one.join(t, "fid")
    s = pairs.withColumn("score", name_score("key", "t")).groupBy("key", "fid", "sources", "name").agg(F.max("score").alias("score"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    n = t.select(F.explode(words("t")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    small = pairs.where("t <> ''").select("key", words("key").alias("a"), words("t").alias("b")).withColumn("few", F.when(F.size("a") <= F.size("b"), F.col("a")).otherwise(F.col("b")))
    inside = small.where((F.size(F.array_except("few", "a")) == 0) & (F.size(F.array_except("few", "b")) == 0))
    rare = inside.select("key", F.explode("few").alias("word")).where(F.length("word") >= 5).distinct().join(n, "word").where("n <= 5").select("key", F.lit(True).alias("rare")).distinct()
    found = s.join(rare, "key", "left")
    return found.where((F.col("score") >= 0.6) | (F.col("sources") >= 2) | F.col("rare")).select("name", "key", "fid", "sources", F.round("score", 6).alias("score"))


def guarded(proposed: DataFrame, owned: DataFrame) -> DataFrame:
    """What becomes of proposed variants: rejected (no name), conflict (another family owns the key), known or new. Both: name or key, fid."""
    p = proposed.withColumn("key", resolver_key(F.col("name"))).join(owned.groupBy("key").agg(F.min("fid").alias("owner"), F.max("fid").alias("last")), "key", "left")
    state = F.when(~is_name(F.col("name")) | (F.col("key") == ""), "rejected").when(F.col("owner").isNull(), "new").when((F.col("owner") == F.col("fid")) & (F.col("last") == F.col("fid")), "known").otherwise("conflict")
    return p.select("name", "fid", state.alias("state"))


def suggested(names: DataFrame, journals: DataFrame, stopwords: list[str]) -> DataFrame:
    """The lowest journal of the same key words; a suggestion for review, never a link."""
    k = journals.select("id", keyword_key(F.col("title"), stopwords).alias("key")).where("key <> ''").groupBy("key").agg(F.min("id").alias("suggested_journal_id"))
    return names.select("name", keyword_key(F.col("name"), stopwords).alias("key")).join(k, "key", "left").select("name", "suggested_journal_id")


def vocabulary_usage(rows: DataFrame) -> DataFrame:
    """Distinct journals by label of their area text. rows: id, area."""
    return rows.select("id", F.explode(F.split(F.coalesce("area", F.lit("")), r"[|;]")).alias("x")).select("id", F.trim("x").alias("label")).where("label <> ''").groupBy("label").agg(F.countDistinct("id").alias("journals"))


def backfilled_keywords(items: DataFrame, legacy: DataFrame) -> DataFrame:
    """Keywords by folded title, if both sides have the title once; what is there stays. items: id, title, keywords; legacy: title, keywords."""
    once = lambda df, c: df.groupBy(topic_key(F.col("title")).alias("k")).agg(F.first(c).alias(c), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    fill = once(items, "id").join(once(legacy, "keywords").withColumnRenamed("keywords", "found"), "k").select("id", "found")
    return items.join(fill, "id", "left").withColumn("keywords", F.coalesce(F.nullif("keywords", F.lit("")), "found")).drop("found")


def _matched_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The theses of one researcher and type, in order, each with the best orientation that is free for it."""
    have = [[o.id, o.s, o.t, o.handle, o.uuid] for o in pdf[pdf["kind"] == "o"].sort_values("id").itertuples()]
    out = []

    def inside(a: str, b: str) -> bool:
        short, long = sorted((a, b), key=len)
        return a != b and len(short.split()) >= 2 and f" {short} " in f" {long} "

    def take(t, weak: bool) -> bool:
        for field, state in ((3, t.handle), (4, t.uuid)):
            for o in have:
                if state and o[field] == state:
                    o[3], o[4] = o[3] or t.handle, o[4] or t.uuid
                    out.append((t.id, o[0], 8, "known"))
                    return True
        best, score = None, 0
        for o in have:
            if t.handle and o[3] and o[3] != t.handle or t.uuid and o[4] and o[4] != t.uuid:
                continue
            titled = t.t and o[2] and len(t.t) > 15
            n = 4 if t.s and t.s == o[1] or titled and t.t == o[2] else 2 if titled and (t.t in o[2] or o[2] in t.t) else 1 if t.s and o[1] and inside(t.s, o[1]) else 0
            if n > score:
                best, score = o, n
        if score == 1 and not weak:
            return False
        if best is None:
            have.append([-t.id, t.s, t.t, t.handle, t.uuid])
            out.append((t.id, None, 0, "new"))
        else:
            best[3], best[4] = best[3] or t.handle, best[4] or t.uuid
            out.append((t.id, best[0], score, "enriched"))
        return True

    later = [t for t in pdf[pdf["kind"] == "t"].sort_values("id").itertuples() if not take(t, False)]
    for t in later:
        take(t, True)
    return pd.DataFrame(out, columns=["id", "oid", "score", "state"]).astype({"id": "int64", "oid": "Int64", "score": "int32"})


def thesis_matches(theses: DataFrame, orientations: DataFrame) -> DataFrame:
    """Each thesis's orientation of the same researcher and type: known by handle or number, else the best score: 4 (equal student, or equal title of over 15
    characters), 2 (one title in the other), 1 (one name in the other by words; only after all surer ones), else new.

    An orientation with another handle or number is another work's; a matched one takes the thesis's, so theses count in their order, which only those of one
    researcher and type share: they meet in one task. A new thesis (oid null; -id where another one matches it) can be matched by later ones.
    Both: id, researcher_id, orientation_type, student, title, handle, uuid; ids are whole numbers.
    """
    side = lambda df, kind: df.where("researcher_id IS NOT NULL").select(
        "researcher_id", "orientation_type", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), normalized(F.coalesce("student", F.lit("")), upper=True).alias("s"), normalized(F.coalesce("title", F.lit("")), upper=True).alias("t"),
        F.coalesce("handle", F.lit("")).alias("handle"), F.coalesce("uuid", F.lit("")).alias("uuid"),
    )
    return side(theses, "t").unionByName(side(orientations, "o")).groupBy("researcher_id", "orientation_type").applyInPandas(_matched_in_order, "id long, oid long, score int, state string")


def enriched_orientations(orientations: DataFrame, theses: DataFrame, matches: DataFrame, columns: list[str]) -> DataFrame:
    """Orientations with the empty ones of the columns filled from their first matched thesis."""
    first = matches.where("oid > 0").groupBy("oid").agg(F.min("id").alias("__t"))
    new = theses.select(F.col("id").alias("__t"), *(F.col(c).alias(f"__{c}") for c in columns))
    j = orientations.join(first.withColumnRenamed("oid", "id"), "id", "left").join(new, "__t", "left")
    return j.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in orientations.columns))


def ai_batches(families: DataFrame, per_file: int) -> DataFrame:
    """Families without an area, or with a low or medium confidence, in numbered batches; one JSON line each. families: fid, title, confidence."""
    todo = families.where("confidence IS NULL OR confidence IN ('low', 'medium')")
    lines = numbered(todo.select("fid", F.to_json(F.struct("fid", "title")).alias("line")), ["fid", "line"], 0, "n")
    return lines.select((F.floor((F.col("n") - 1) / per_file) + 1).alias("batch"), "fid", "line")


def imported_batch(lines: DataFrame, families: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Z11 back: n, reason (null: taken), fid, primary, secondary and confidence of each JSON line of a batch.

    Reasons in their order: invalid_json, missing_key, unclassifiable (primary is null), invalid_primary, invalid_secondary (an unknown slug, or more than two others),
    invalid_confidence (not a number between 0 and 1), unknown or ambiguous family, duplicate_family after the first. Blank lines go.
    lines: n, line; families: key (`issn:...` or `title:...`), fid; taxonomy: slug.
    """
    v = F.try_parse_json("line")
    get = lambda c, t: F.try_variant_get(F.col("v"), f"$.{c}", t)
    kind = lambda c: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{c}", "variant"))
    slugs = taxonomy.agg(F.collect_set("slug").alias("known"))  # the taxonomy, in one row
    r = lines.where("trim(line) <> ''").select("n", v.alias("v")).crossJoin(slugs)
    r = r.select(
        "n", "known", (F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).alias("object"), F.when(kind("key") == "STRING", F.trim(get("key", "string"))).alias("key"), kind("primary").alias("pk"), get("primary", "string").alias("primary"),
        kind("secondary").alias("sk"), get("secondary", "array<string>").alias("listed"), kind("confidence").alias("ck"), get("confidence", "double").alias("confidence"),
    )
    others = F.array_distinct(F.filter(F.coalesce("listed", F.array()), lambda s: s != F.col("primary")))
    listed_ok = F.col("sk").isNull() | ((F.startswith("sk", F.lit("ARRAY"))) & F.forall(F.coalesce("listed", F.array()), lambda s: s.isNotNull() & F.array_contains("known", s)) & (F.size(others) <= 2))
    number = F.coalesce(F.col("ck").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT|LONG)"), F.lit(False)) & F.col("confidence").between(0, 1)
    bad = (
        F.when(~F.coalesce("object", F.lit(False)), "invalid_json").when(F.coalesce("key", F.lit("")) == "", "missing_key").when(F.col("pk") == "VOID", "unclassifiable").when((F.coalesce("pk", F.lit("")) != "STRING") | ~F.array_contains("known", F.col("primary")), "invalid_primary")
        .when(~F.coalesce(listed_ok, F.lit(False)), "invalid_secondary").when(~F.coalesce(number, F.lit(False)), "invalid_confidence")
    )
    owners = families.groupBy("key").agg(F.min("fid").alias("fid"), (F.min("fid") != F.max("fid")).alias("several"))
    j = r.withColumns({"bad": bad, "secondary": others}).join(owners, "key", "left")
    reason = F.coalesce("bad", F.when(F.col("fid").isNull(), "unknown_family").when(F.col("several"), "ambiguous_family"))
    j = j.withColumn("reason", reason)
    w = Window.partitionBy(F.when(F.col("reason").isNull(), F.concat(F.lit("f"), F.col("fid").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("n").cast("string")))).orderBy("n")
    j = j.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(w) > 1, "duplicate_family")))
    taken = F.col("reason").isNull()
    return j.select("n", "reason", F.when(taken, F.col("fid")).alias("fid"), F.when(taken, F.col("primary")).alias("primary"), F.when(taken, F.array_join("secondary", ",")).alias("secondary"), F.when(taken, F.col("confidence")).alias("confidence"))


def batch_evidence(batch: DataFrame, name: str) -> DataFrame:
    """Z11 back: evidence of the taken lines: the primary area with weight 1, secondary ones 0.5."""
    rows = F.concat(F.array(F.struct(F.col("primary").alias("label"), F.lit("primary").alias("role"), F.lit("1.0000").cast("decimal(6,4)").alias("weight"))), F.transform(F.filter(F.split("secondary", ","), lambda s: s != ""), lambda s: F.struct(s.alias("label"), F.lit("secondary").alias("role"), F.lit("0.5000").cast("decimal(6,4)").alias("weight"))))
    return batch.where("reason IS NULL").select("fid", F.lit("ai").alias("source"), F.lit(name).alias("batch"), "confidence", F.explode(rows).alias("r")).select("fid", "source", "batch", "confidence", "r.*")


def overridden(journals: DataFrame, events: DataFrame) -> DataFrame:
    """Manual events of area, display title and family applied in order: of each row and field the last one wins; an unknown family, or one that is itself a member, is passed over.

    journals: id, area, display_title, canonical_journal_id; events: n, id, field, value. A family event names the canonical row; the row itself, or an empty value, makes it one of its own.
    """
    last = events.groupBy("id").pivot("field", ["area", "display_title", "family"]).agg(F.max_by("value", "n"))
    heads = journals.where("canonical_journal_id IS NULL").select(F.col("id").alias("__h"), F.lit(True).alias("__head"))
    target = F.col("family").try_cast("bigint")
    j = journals.join(last.select("id", F.col("area").alias("__a"), F.col("display_title").alias("__t"), F.col("family"), target.alias("__h")), "id", "left").join(heads, "__h", "left")
    alone = F.col("family").isNotNull() & ((F.col("family") == "") | (F.col("__h") == F.col("id")))
    family = F.when(alone, F.lit(None).cast("bigint")).when(F.col("__head"), F.col("__h")).otherwise(F.col("canonical_journal_id"))
    return j.withColumns({"area": F.coalesce("__a", "area"), "display_title": F.coalesce("__t", "display_title"), "canonical_journal_id": family}).select(*journals.columns)


def overridden_names(names: DataFrame, events: DataFrame) -> DataFrame:
    """The names of families after manual events: `name` gives a key to a family, `name_reject` takes it from all; of each key the last event wins. names: key, fid; events: n, id, field, value."""
    e = events.where(F.col("field").isin("name", "name_reject")).withColumn("key", resolver_key(F.col("value"))).where("key <> ''")
    last = e.groupBy("key").agg(F.max_by(F.struct("field", "id"), "n").alias("x")).select("key", F.col("x.field").alias("field"), F.col("x.id").alias("fid"))
    return names.join(last.select("key"), "key", "left_anti").select("key", "fid").unionByName(last.where("field = 'name'").select("key", "fid"))


def write_snapshot(links: DataFrame, path: str) -> None:
    """The links of an audit as JSON lines."""
    links.write.mode("overwrite").json(path)
