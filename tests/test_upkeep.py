"""Merges, the author thesaurus, keyed tables: against plain versions on random input."""

import collections
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quercus.operators import entities, merges, thesaurus
from quercus.sources.keyed import KeyedTable


# --- merges ---
def test_roots_of_random_forests(spark):
    rng = random.Random(1)
    for n in (1, 2, 40, 300):
        to = {i: rng.randrange(i) for i in range(1, n) if rng.random() < 0.9}
        if n == 300:
            to |= {i: i - 1 for i in range(1, 200)}  # a long chain

        def root(x):
            while x in to:
                x = to[x]
            return x

        rows = list(to.items()) + [(5, 5), (None, 3), (3, None)] + list(to.items())[:3]
        got = {r.old: r.new for r in merges.roots(spark.createDataFrame(rows, "old long, new long")).collect()}
        assert got == {i: root(i) for i in to}
    with pytest.raises(ValueError, match="ring"):
        merges.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "old long, new long"))
    with pytest.raises(ValueError, match="several"):
        merges.roots(spark.createDataFrame([(1, 2), (1, 3)], "old long, new long"))


def test_merged_institutions(spark):
    i = spark.createDataFrame([(1, "Universidade Um", "UU", "U1", None, "pública"), (2, "Universidade  Um ", None, "U-1", "Fundação Um", "x"), (3, "Univ. Um", "UU", None, "", None), (9, "Outra", None, None, None, None)], "id long, official_name string, short_name string, acronym string, corporate_name string, type string")
    v = spark.createDataFrame([(1, "UNI UM", "UNI UM", "alternative"), (3, "uni um", "UNI UM", "alternative"), (3, "Antiga Um", "ANTIGA UM", "alternative"), (9, "O", "O", "alternative")], "entity_id long, name string, key string, kind string")
    m = spark.createDataFrame([(3, 2), (2, 1)], "old long, new long")
    e = spark.createDataFrame([(10, 3), (11, 2), (12, 1), (13, 9), (14, None)], "id long, institution_id long")
    chosen = spark.createDataFrame([(1, "type", ""), (1, "official_name", "Universidade Um do Sul"), (9, "type", "privada")], "id long, column string, value string")
    stay, names, tables = merges.merged_institutions(i, v, m, {"experiences": (e, "institution_id")}, chosen)
    assert sorted(map(tuple, stay.collect())) == [(1, "Universidade Um do Sul", "UU", "U1", None, None), (9, "Outra", None, None, None, "privada")]
    assert sorted((r.entity_id, r.key, r.name) for r in names.collect()) == [
        (1, "ANTIGA UM", "Antiga Um"), (1, "FUNDACAO UM", "Fundação Um"), (1, "U 1", "U-1"), (1, "U1", "U1"), (1, "UNI UM", "UNI UM"), (1, "UNIV UM", "Univ. Um"), (1, "UNIVERSIDADE UM", "Universidade Um"), (1, "UU", "UU"), (9, "O", "O"),
    ]
    assert sorted(map(tuple, tables["experiences"].collect()), key=str) == [(10, 1), (11, 1), (12, 1), (13, 9), (14, None)]


def test_merged_authors(spark):
    a = spark.createDataFrame([(1, "Ana Sá"), (2, "SÁ, A."), (3, "A. Sá")], "id long, preferred_name string")
    ids = spark.createDataFrame([(1, 1, "orcid", "x"), (2, 2, "orcid", "x"), (3, 3, "scopus", "7"), (4, 3, "orcid", "y")], "id long, entity_id long, provider string, identifier string")
    none = spark.createDataFrame([], "entity_id long, name string, key string, kind string")
    stay, names, moved = merges.merged_authors(a, none, ids, spark.createDataFrame([(2, 1), (3, 2)], "old long, new long"))
    assert [tuple(r) for r in stay.collect()] == [(1, "Ana Sá")] and sorted((r.name, r.kind) for r in names.collect()) == [("A. Sá", "merge"), ("SÁ, A.", "merge")]
    assert sorted(map(tuple, moved.collect())) == [(1, 1, "orcid", "x"), (3, 1, "scopus", "7"), (4, 1, "orcid", "y")]


def test_chains_of_journals(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, journal_id long")
    assert sorted(map(tuple, entities.remapped(df, "journal_id", spark.createDataFrame([(5, 6), (6, 7)], "old long, new long")).select("id", "journal_id").collect())) == [(1, 7), (2, 7), (3, 7)]


# --- author thesaurus ---
def key(x):
    import unicodedata

    x = "".join(c for c in unicodedata.normalize("NFD", x.strip()[:250]) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()).upper()


def turned(x):
    if "," in x:
        a, b = x.split(",", 1)
        return f"{b.strip()} {a.strip()}".strip()
    w = x.split()
    return f"{w[-1]}, {' '.join(w[:-1])}" if len(w) > 1 else None


def plain_sync(identities, variants, identifiers, researchers, authors):
    """One by one, by the rules of the module's head."""
    by_name, known = {}, {}
    for i, _, n in sorted(identities):
        by_name.setdefault(n, i)
    for _, i, _, n, _ in sorted(variants):
        known.setdefault(n, i)
    owner, new_ids, new_variants, last = dict(known), [], [], max((i for i, _, _ in identities), default=0)
    has = {i for i, p, _ in identifiers if p == "orcid"}
    orcids = []
    for _, name, cited, orcid in sorted(researchers):
        k = key(name or "")
        if not k:
            continue
        i = by_name.get(k) or known.get(k)
        if not i:
            last += 1
            i = by_name[k] = last
            new_ids.append((i, name.strip(), k))
        for n, source in [(name.strip(), "lattes")] + [(c.strip(), "citation") for c in (cited or "").split(";")]:
            if key(n) and key(n) not in owner:
                owner[key(n)] = i
                new_variants.append((i, n, key(n), source))
        if orcid and i not in has:
            has.add(i)
            orcids.append((i, "orcid", orcid))
    rows = {((n or "").strip() or (c or "").strip(), (c or "").strip()) for n, c in authors}
    rows = {(n, c): [key(n), key(c), key(turned(n) or ""), key(turned(c) or "") if c else ""] for n, c in rows if key(n)}
    every, home = dict(rows), {}
    look = dict(owner)
    first = True
    while True:
        placed = {}
        for r, k in rows.items():
            found = [look[x] for x in k if x and x in look] + ([by_name[x] for x in (k[0], k[2]) if x in by_name] if first else [])
            if found:
                placed[r] = found[0]
        if not placed:
            break
        home |= placed
        claims = collections.defaultdict(list)
        for r, i in placed.items():
            if rows[r][1] and rows[r][1] not in owner:
                claims[rows[r][1]].append((i, r[1]))
        fresh = collections.defaultdict(list)
        for k, x in claims.items():
            i, n = min(x)
            new_variants.append((i, n, k, "citation"))
            fresh[k].append(i)
        for r, i in placed.items():
            if rows[r][1] in claims and rows[r][3]:
                fresh[rows[r][3]].append(i)
        look = {k: min(x) for k, x in fresh.items() if k not in owner}
        owner |= look
        rows = {r: k for r, k in rows.items() if r not in placed}
        first = False
    canon = {r: turned(r[0]) if "," in r[0] and k[2] else r[0] for r, k in rows.items()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r, k in rows.items():
        for x in [*k, key(canon[r])]:
            if x:
                a, b = find(k[0]), find(x)
                root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for r, k in rows.items():
        groups[find(k[0])].append(r)
    for g in sorted(groups):
        last += 1
        k, n = min((key(canon[r]), canon[r]) for r in groups[g])
        new_ids.append((last, n, k))
        home |= dict.fromkeys(groups[g], last)
        new_variants.append((last, n, k, "production"))
        for x in {rows[r][1] for r in groups[g]} - {"", k}:
            new_variants.append((last, min(r[1] for r in groups[g] if rows[r][1] == x), x, "citation"))
    stored = {*known, *(v[2] for v in new_variants)}
    called = {*(n for _, _, n in identities), *(n for _, _, n in new_ids)}
    lost = collections.defaultdict(list)
    for r, k in every.items():
        if not stored & {x for x in k if x} and not called & {k[0], k[2]}:
            lost[k[0]].append((home[r], r[0]))
    new_variants += [(*min(x), k, "production") for k, x in lost.items()]
    return new_ids, new_variants, orcids


@pytest.mark.parametrize("seed", [1])
def test_thesaurus_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    given, last = ["Ana", "Bia", "Caio", "Davi", "Eva", "José"], ["Sá", "Luz", "Reis", "Melo", "Prado"]

    def name():
        return f"{rng.choice(given)} {rng.choice(last)}" if rng.random() < 0.8 else f"{rng.choice(given)} {rng.choice(given)} {rng.choice(last)}"

    def short(n):
        return f"{n.split()[-1].upper()}, {n[0]}." if rng.random() < 0.7 else turned(n)

    names = [name() for _ in range(14)]
    identities = [(i + 1, n, key(n)) for i, n in enumerate(names[:4])]
    variants = [(i + 1, rng.randint(1, 4), v, key(v), "manual") for i, v in enumerate([short(n) for n in names[:6]] + [names[8]])]
    identifiers = [(1, "orcid", "0-1")]
    researchers = [(i + 10, n, ";".join(short(x) for x in [n, *rng.sample(names, rng.randint(0, 2))]), rng.choice(["", f"o{i}"])) for i, n in enumerate(names[3:9])] + [(50, "  ", "X", None), (51, None, None, None)]
    authors = [(rng.choice([n, turned(n), n.upper(), ""]), rng.choice([short(n), short(rng.choice(names)), "", None])) for n in (rng.choice(names) if rng.random() < 0.6 else name() + rng.choice(["", " Neto"]) for _ in range(60))] + [(None, None), ("", ""), ("...", "")]
    f = lambda rows, schema: spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    got = thesaurus.synced(
        f(identities, "id long, preferred_name string, normalized_name string"), f(variants, "id long, identity_id long, name string, normalized_name string, source string"), f(identifiers, "identity_id long, provider string, identifier string"),
        f(researchers, "id long, full_name string, citation_names string, orcid string"), f(authors, "author_name string, citation_name string"),
    )
    ids, new, orcids = plain_sync(identities, variants, identifiers, researchers, authors)
    assert sorted(map(tuple, got[0].collect())) == sorted(identities + ids)
    assert sorted(tuple(r)[1:] for r in got[1].where("id IS NULL").collect()) == sorted(new)
    assert got[1].where("id IS NOT NULL").count() == len(variants)
    assert sorted(map(tuple, got[2].collect())) == sorted(identifiers + orcids)
    # Once more: nothing is created, joined or lost.
    w = got[1].withColumn("id", F.coalesce("id", F.lit(1000) + F.col("identity_id")))
    again = thesaurus.synced(got[0], w, got[2], f(researchers, "id long, full_name string, citation_names string, orcid string"), f(authors, "author_name string, citation_name string"))
    assert sorted(map(tuple, again[0].collect())) == sorted(identities + ids) and sorted(map(tuple, again[2].collect())) == sorted(identifiers + orcids)


# --- keyed tables ---
def test_upsert_is_that_of_a_database(spark, tmp_path):
    rng = random.Random(4)
    db = duckdb.connect()
    db.execute("CREATE TABLE t (a BIGINT, b VARCHAR, n BIGINT, top DOUBLE, name VARCHAR, note VARCHAR, PRIMARY KEY (a, b))")
    rows = [(i, "k", i, float(i), f"n{i}" if i % 3 else "", "old") for i in range(200)]
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    schema = "a long, b string, n long, top double, name string, note string"
    table = KeyedTable.create(spark.createDataFrame(rows, schema), f"file://{tmp_path}/t", ["a", "b"], 16)

    def same():
        return sorted(map(tuple, table.read().collect()), key=str) == sorted(db.execute("SELECT * FROM t").fetchall(), key=str)

    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, x in os.walk(tmp_path) for f in x if f.endswith(".parquet")}
    assert same()
    before = files()
    batch = [(i, "k", rng.randint(1, 9), rng.random() * 300, "new", None) for i in (3, 7, 500)]
    touched = table.upsert(spark.createDataFrame(batch, schema), {"n": "add", "top": "greatest", "name": "fill", "note": "keep"})
    for r in batch:
        db.execute("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?) ON CONFLICT DO UPDATE SET n = t.n + excluded.n, top = greatest(t.top, excluded.top), name = coalesce(nullif(t.name, ''), excluded.name), note = t.note", r)
    assert same() and len(touched) <= 3
    assert all(files()[f] == t for f, t in before.items()) and len(files()) < 2 * len(before)
    more = [(i, "k", 1, 0.0, "y", "z") for i in (3, 600, 601)]
    table.upsert(spark.createDataFrame(more, schema), ignore=True)
    db.executemany("INSERT OR IGNORE INTO t VALUES (?, ?, ?, ?, ?, ?)", more)
    assert same()
    part = spark.createDataFrame([(7, "k", "replaced", 1), (7, "k", "last", 2), (700, "k", "fresh", 1)], "a long, b string, name string, at int")
    table.upsert(part, order=F.col("at"))
    db.execute("UPDATE t SET name = 'last' WHERE a = 7")
    db.execute("INSERT INTO t (a, b, name) VALUES (700, 'k', 'fresh')")
    assert same()
    assert table.upsert(part.where("false")) == [] and same()
    with pytest.raises(Exception, match="key is null"):
        table.upsert(spark.createDataFrame([(None, "k", "x")], "a long, b string, name string"))
    assert same()
    with pytest.raises(FileExistsError):
        KeyedTable.create(part, f"file://{tmp_path}/t", ["a"])
