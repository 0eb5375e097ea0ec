"""The line of 22 steps: stops, goes on where it stopped, redoes only what hangs on a change, and ends the same."""

import pytest
from pyspark.sql import functions as F

from quercus.operators import journal_pipeline
from quercus.plans.steps import Failed, Pipeline, Step

RULES = [("educacao", "educacao"), ("fisica", "fisica")]


def sources(spark, folder):
    j = [
        (1, "Educação & Sociedade", "0101-7330", "A1", None, "EDUCACAO", None, None, "", False), (2, "Educação e Sociedade (online)", "1678-4626", "A2", None, "", None, None, "", False), (3, "Revista de Física", None, "B1", "Física", None, None, None, "", False),
        (4, "Outra Coisa", None, None, None, None, None, None, "", False), (5, "Ensino de Ciências", "1413-2478", "B2", None, None, None, None, "", False),
    ]
    tables = {
        "journals": (j, "id long, title string, issn string, qualis string, area string, area_raw string, canonical_journal_id long, method string, display_title string, areas_locked boolean"),
        "records": ([("wos", "w1", "Educação e Sociedade", ["0101-7330", "1678-4626"], ["Education"], "BR"), ("scielo", "s1", "Revista de Física", ["0102-4744"], ["Physics"], "BR"), ("pubmed", "p1", "Ensino de Ciências", ["1413-2478"], ["Nothing"], None)], "src string, rec string, title string, issns array<string>, labels array<string>, country string"),
        "items": ([(1, "ARTIGO", "t1", 2020, 7, "Educação & Sociedade", None, None), (2, "ARTIGO", "t2", 2021, 7, "Educ. Soc.", "1678-4626", None), (3, "ARTIGO", "t3", 2021, 8, "EDUC SOC", "0101-7330", None), (4, "ARTIGO", "t4", 2022, 8, "Educ. Soc.", None, None), (5, "LIVRO", "t5", 2022, 8, "Educação & Sociedade", None, 9), (6, "ARTIGO", "t6", 2022, 8, "Nirgends", None, None)], "id long, item_type string, title string, year int, researcher_id long, journal_name string, issn string, qualis_journal_id long"),
        "links": ([(1, 1), (1, 2), (3, 1)], "journal_id long, database_id int"), "crosswalk": ([("wos", "Education", "educacao"), ("scielo", "Physics", "fisica")], "vocabulary string, label string, slug string"),
        "taxonomy": ([(1, "educacao", "Educação", None, 1), (2, "fisica", "Física", None, 1), (3, "ciencias-da-saude", "Ciências da Saúde", None, 1)], "id int, slug string, name string, parent string, level int"),
        "thesaurus": ([], "vocabulary string, label string, slug string, manual boolean, status string, occurrences long"),
        "overrides": ([(1, 4, "area", "fisica"), (2, 4, "display_title", "Outra")], "n long, id long, field string, value string"),
    }
    out = {}
    for name, (rows, schema) in tables.items():
        out[name] = f"{folder}/{name}"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(out[name])
    return out


def state(tables):
    return {n: sorted(map(str, df.select(*sorted(df.columns)).collect())) for n, df in tables.items()}


def test_line_of_steps(spark, tmp_path):
    given = sources(spark, f"file://{tmp_path}/in")
    whole, report = journal_pipeline.run(spark, f"file://{tmp_path}/a", given, RULES)
    assert len(report) == 22 and {s for n, s in report if n != "ai-import"} == {"done"} and dict(report)["ai-import"] == "skipped"
    want = state(whole)
    items = {r.id: r.qualis_journal_id for r in whole["items"].collect()}
    assert items[1] == items[2] == items[3] or {items[1], items[2], items[3]} <= {1, 2}
    assert items[4] in (1, 2) and items[5] is None and items[6] is None  # learned from two linked articles
    assert {r.id: r.canonical_journal_id for r in whole["journals"].collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    areas = {(r.id, r.area, r.method) for r in whole["areas"].collect()}
    assert {(1, "educacao", "auto"), (2, "educacao", "auto"), (3, "fisica", "auto"), (4, "fisica", "manual"), (5, "ciencias-da-saude", "auto")} <= areas
    assert whole["report"].first().families == 4 and {r.state: r.rows for r in whole["audit"].collect()} == {"gained": 4, "same": 1}
    # Killed at a step, and run again
    for at in (9,):
        folder = f"file://{tmp_path}/at{at}"
        steps = journal_pipeline.steps(spark, RULES)
        broken = [Step(s.name, s.reads, s.run if i < at else lambda t: 1 / 0, s.version, s.when, s.optional) for i, s in enumerate(steps)]
        with pytest.raises(Failed, match=steps[at].name) as e:
            Pipeline(spark, folder, broken).run(given)
        assert len(e.value.report) == at
        again, report = Pipeline(spark, folder, steps).run(given)
        assert state(again) == want and [s for _, s in report[:at]] == ["kept"] * at and "kept" not in {s for _, s in report[at:]}
    # Nothing changed: nothing is done. One source changed: only what hangs on it.
    again, report = journal_pipeline.run(spark, f"file://{tmp_path}/a", given, RULES)
    assert state(again) == want and {s for _, s in report} == {"kept", "skipped"}
    spark.createDataFrame([(3, 2)], "journal_id long, database_id int").write.mode("overwrite").parquet(given["links"])
    _, report = journal_pipeline.run(spark, f"file://{tmp_path}/a", given, RULES)
    done = {n for n, s in report if s == "done"}
    assert {"index", "families", "learn", "report"} <= done and not done & {"normalize-titles", "audit-before", "scielo-enrich", "evidence-load", "families-first"}


def test_chosen_steps(spark, tmp_path):
    source = spark.range(3).toDF("x")
    plus = lambda by: lambda t: {"a": t["a"].select((F.col("x") + by).alias("x"))}
    p = Pipeline(spark, f"file://{tmp_path}", [Step("one", ["a"], plus(1)), Step("two", ["a"], plus(10)), Step("three", ["a"], plus(100))])
    total = lambda r: r[0]["a"].agg(F.sum("x")).first()[0]
    assert total(p.run({"a": source})) == 3 + 3 * 111
    assert total(p.run({"a": source}, only=["one"])) == 3 + 3 * 111  # the later ones are as they were
    tables, report = p.run({"a": source}, first="three", skip=["one"])
    assert report == [("three", "done")] and total((tables, report)) == 3 + 3 * 111
    with pytest.raises(ValueError, match="no step four"):
        p.run({"a": source}, only=["four"])
    with pytest.raises(Failed, match="'one' failed"):
        p.run({})
    with pytest.raises(ValueError, match="one name"):
        Pipeline(spark, f"file://{tmp_path}", [Step("x", [], plus(1)), Step("x", [], plus(1))])


def test_steps_broadcast_by_measured_sizes(spark, tmp_path):
    """A table whose files are small for its rows isn't gathered in the driver; outside the steps the session is as it was."""
    ids = spark.range(0, 300_000, 1, 2).select("id", *(F.lit(None).cast("string").alias(f"c{i}") for i in range(9)))
    ids.write.parquet(f"file://{tmp_path}/ids")
    seen = []

    def joined(t):
        out = t["ids"].join(t["ids"].select("id"), "id", "left")
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return {"out": out}

    tables, _ = Pipeline(spark, f"file://{tmp_path}/line", [Step("join", ["ids"], joined)]).run({"ids": f"file://{tmp_path}/ids"})
    outside = spark.read.parquet(f"file://{tmp_path}/ids")
    assert "Broadcast" not in seen[0] and tables["out"].count() == 300_000
    assert "Broadcast" in outside.join(outside.select("id"), "id", "left")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Failed):
        Pipeline(spark, f"file://{tmp_path}/line", [Step("fail", ["ids"], lambda t: 1 / 0)]).run({"ids": f"file://{tmp_path}/ids"})
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
