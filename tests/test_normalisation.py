"""Normalisation after changes is that of a full run, and makes only what changed anew."""

import random

from quercus.operators import normalisation

SCHEMAS = {
    "researchers": "id long, admission_year int, leave_year int, status int", "items": "id long, researcher_id long, item_type string, journal_name string, issn string", "authors": "id long, researcher_id long, author_name string, citation_name string",
    "educations": "id long, researcher_id long, institution_name string", "experiences": "id long, researcher_id long, institution_name string, role_name string, contract_type string, start_year int, end_year int, is_current boolean",
}
LOOKUPS = {
    "journals": "id long, title string, issn string, qualis string, canonical_journal_id long", "links": "journal_id long, database_id int", "people": "id long, name string", "author_variants": "name string, identity_id long", "identities": "id long, preferred_name string",
    "institutions": "id long, name string",
}


def plain_affiliation(r, bonds, year):
    own = [b for b in bonds if "sede" in (b[2] or "").lower()]
    ongoing = any(b[7] or b[6] is None or b[6] >= year for b in own)
    ended = [b[6] for b in own if not (b[7] or b[6] is None or b[6] >= year) and 1960 < b[6] < year]
    starts = [b[5] for b in own if b[5] and 1960 < b[5] <= year and not any(w in f"{b[3]} {b[4]}".lower() for w in ("substituto", "aluno", "bolsista", "estagi", "temporário"))]
    _, admission, leave, status = r
    admission = admission or (min(starts) if starts else admission)
    if ongoing:
        return r[0], admission, None if leave is not None and leave < year else leave, 1
    if ended:
        return r[0], admission, max(ended) if not leave or leave >= year else leave, 0
    return r[0], admission, leave, status


def test_changes_are_propagated(spark):
    rng = random.Random(9)
    data = {
        "researchers": [(i, rng.choice([None, 0, 1990]), rng.choice([None, 0, 2010, 2030]), rng.choice([0, 1])) for i in range(1, 13)],
        "items": [(n, rng.randint(1, 12), rng.choice(["ARTIGO", "ARTIGO", "LIVRO"]), rng.choice(["Revista A", "revista a", "Revista B", "Nova", None, ""]), rng.choice([None, "0101-7330"])) for n in range(60)],
        "authors": [(n, rng.randint(1, 12), rng.choice(["Ana Sá", "Bia Luz", "Eva", "", None]), rng.choice(["SÁ, Ana", "LUZ, B.", "", None])) for n in range(60)],
        "educations": [(n, rng.randint(1, 12), rng.choice(["Sede", "Fora", "Longe", None])) for n in range(20)],
        "experiences": [(n, rng.randint(1, 12), rng.choice(["Sede Central", "Fora", "SEDE"]), rng.choice([None, "Professor", "Professor substituto"]), rng.choice([None, "Bolsista", "Servidor"]), rng.choice([None, 1950, 1995, 2005]), rng.choice([None, 1955, 2009, 2026]), rng.random() < 0.1) for n in range(40)],
    }
    look = {
        "journals": [(1, "Revista A", "0101-7330", "A1", None), (2, "Revista B", None, "B1", None)], "links": [(1, 1), (1, 2)], "people": [(1, "Ana Sá"), (2, "Bia Luz")], "author_variants": [("LUZ, B.", 50)], "identities": [(50, "Bia Luz")], "institutions": [(1, "Sede"), (2, "Fora")],
    }
    frames = lambda rows, schemas: {t: spark.createDataFrame(rows[t], schemas[t]) for t in schemas}
    state = lambda out: {t: sorted(map(str, df.select(*sorted(df.columns)).collect())) for t, df in out.items()}
    out, known = normalisation.normalised(frames(data, SCHEMAS), frames(look, LOOKUPS), "sede", 2026)
    bonds = lambda i: [e for e in data["experiences"] if e[1] == i]
    assert sorted(map(tuple, out["researchers"].collect()), key=str) == sorted((plain_affiliation(r, bonds(r[0]), 2026) for r in data["researchers"]), key=str)
    links = {r.id: r.qualis_journal_id for r in out["items"].collect()}
    assert all(links[i] == (None if t != "ARTIGO" else 1 if issn or (name or "").lower() == "revista a" else 2 if name == "Revista B" else None) for i, _, t, name, issn in data["items"])
    matched = {r.id: r.matched_researcher_id for r in out["authors"].collect()}
    assert all(matched[i] == (1 if c == "SÁ, Ana" else 2 if c == "LUZ, B." else {"Ana Sá": 1, "Bia Luz": 2}.get(n)) for i, _, n, c in data["authors"])
    # Own rows of two researchers, a new one, one that goes; a journal that a name leads to now, another stratum, an institution that goes.
    data["items"] = [r for r in data["items"] if r[1] != 12] + [(100, 3, "ARTIGO", "Revista B", None), (101, 20, "ARTIGO", "Nova", None)]
    for t in ("authors", "educations", "experiences"):
        data[t] = [r for r in data[t] if r[1] != 12]
    data["researchers"] = [r for r in data["researchers"] if r[0] != 12] + [(20, None, None, 1)]
    changes = [{}, {"journals": [*look["journals"], (3, "Nova", None, "C", None)]}, {"journals": [(1, "Revista A", "0101-7330", "A2", None), look["journals"][1]], "institutions": [(1, "Sede")], "people": [(2, "Bia Luz")]}]
    for change in changes:
        look |= change
        new, new_known, again = normalisation.renormalised(out, known, frames(data, SCHEMAS), frames(look, LOOKUPS), "sede", 2026)
        full, _ = normalisation.normalised(frames(data, SCHEMAS), frames(look, LOOKUPS), "sede", 2026)
        assert state(new) == state(full)
        made = {r.owner for r in again.collect()}
        if not change:
            assert made == {3, 12, 20}
        elif "journals" in change and len(change["journals"]) == 3:
            assert made == {r[1] for r in data["items"] if r[2] == "ARTIGO" and r[3] == "Nova" and not r[4]}
        out, known = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in new.items()}, new_known
