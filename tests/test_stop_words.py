"""The words that the topic index takes for no terms: results worked out by hand from the original's list."""

import pytest

from quercus import queries as engine
from quercus.operators import topics
from test_oracle import SF, duck  # noqa: F401

#: Titles of words that are no terms, from each part of the original's list, and of connectors.
NO_TERMS = [
    "estivéssemos, houvermos e tínhamos", "aqueles vocês deles nossas tém", "Parecer do comitê de ética do hospital das clínicas", "UNESP UNICAMP UFSCar USP", "São Carlos, Ribeirão Preto, São Paulo", "docentes e alunos do campus",
    "Fundação de Amparo à Pesquisa do Estado", "membro avaliador, comissão, coordenadora", "sociedade brasileira; reunião e jornada", "Social data", "guia periódico; consultoria ad hoc submetida",
]


def test_no_word_of_the_list_is_a_term(spark):
    titles = spark.createDataFrame(list(enumerate([*NO_TERMS, "Teoria do Estado Novo"])), "id long, title string")
    assert {(r.id, r.term) for r in topics.mined(titles, engine.INDEX_STOPS).collect()} == {(len(NO_TERMS), "teoria"), (len(NO_TERMS), "novo")}
    assert len(engine.INDEX_STOPS) == len(set(engine.INDEX_STOPS)) == 305


@pytest.mark.parametrize("name", ["x4_five_branches", "x5_links"])
def test_index_has_the_whole_list(spark, duck, name):  # noqa: F811
    """'Teoria do Estado Novo' is the other title of some orientations; 'estado' is no term, so nothing is compounded with it."""
    for keys in ({r.key for r in engine.QUERIES[name](spark, SF).select("key").collect()}, {k for (k,) in duck.execute(f"SELECT key FROM ({engine.SQL[name]})").fetchall()}):
        assert {"teoria", "novo"} <= keys and not [k for k in keys if "estado" in k]
