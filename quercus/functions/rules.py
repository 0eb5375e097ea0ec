"""Ordered substring rules (inventory N5, N9, N23, N27) and the mixed name score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import rule_chain

# Substrings of a normalised course name and the canonical course; the first rule that fits wins.
COURSES = [
    ("Pedagogia", ["pedagogia", "complementacao pedagogica"]),
    ("Ciências Sociais", ["ciencias sociais", "social sciences", "estudos sociais", "ciencias politicas e sociais"]),
    ("Psicologia", ["psicologia", "psicologo"]),
    ("Filosofia", ["filosofia", "philosophy"]),
    ("Linguística", ["linguistica"]),
    ("Letras", ["letras", "lingua portuguesa", "portugues", "frances", "espanhol", "ingles", "alemao", "sanscrito"]),
    ("História", ["historia"]),
    ("Direito", ["direito", "ciencias juridicas"]),
    ("Biblioteconomia", ["biblioteconomia", "ciencia da informacao", "estudos de documentacao"]),
    ("Educação Especial", ["educacao especial"]),
    ("Educação Escolar", ["educacao escolar"]),
    ("Educação Física", ["educacao fisica"]),
    ("Educação", ["educacao", "education"]),
    ("Imagem e Som / Audiovisual", ["imagem e som", "cinema", "audiovisual"]),
    ("Música", ["musica", "piano", "clarineta", "flauta doce"]),
    ("Sociologia", ["sociologia"]),
    ("Ciência Política", ["ciencia politica", "ciencias politicas"]),
    ("Antropologia", ["antropologia"]),
    ("Engenharia de Materiais", ["engenharia de materiais"]),
    ("Engenharia Mecânica", ["engenharia mecanica"]),
    ("Engenharia de Produção", ["engenharia de producao"]),
    ("Engenharia Elétrica", ["engenharia eletrica"]),
    ("Engenharia Metalúrgica", ["engenharia metalurgica", "metalurgica"]),
    ("Engenharia Mecatrônica", ["engenharia mecatronica"]),
    ("Engenharia", ["engenharia", "escola de engenharia"]),
    ("Comunicação Social / Jornalismo", ["comunicacao social", "jornalismo", "relacoes publicas"]),
    ("Administração", ["administracao"]),
    ("Ciências Econômicas", ["economia", "ciencias economicas"]),
    ("Artes Visuais & Cênicas", ["artes visuais", "artes plasticas", "artes cenicas", "desenho e plastica"]),
    ("Física", ["fisica", "ciencias exatas"]),
    ("Química", ["quimica"]),
    ("Matemática", ["matematica"]),
    ("Ciências Biológicas", ["biologia", "ciencias biologicas"]),
    ("Ciência da Computação", ["ciencia da computacao", "processamento de dados", "tecnologia da informacao"]),
    ("Ciência de Dados", ["ciencia de dados"]),
    ("Fonoaudiologia", ["fonoaudiologia"]),
    ("Enfermagem", ["enfermagem", "obstetricia"]),
    ("Medicina Veterinária", ["medicina veterinaria"]),
    ("Zootecnia", ["zootecnia"]),
    ("Odontologia", ["odontologia"]),
    ("Gestão e Análise Ambiental", ["gestao e analise ambiental"]),
]
# Classes of institutions that researchers leave for.
INSTITUTION_TYPES = [
    ("Estadual Paulista (USP/UNESP/UNICAMP)", ["usp", "unesp", "unicamp", "estadual paulista", "universidade de são paulo", "estadual de campinas"]),
    ("Universidade Federal (IFES)", ["federal", "unifesp", "ufrgs", "ufms", "ufsc", "uff", "unb", "ufpr", "ufpe", "ufal", "ufpb", "unilab", "ufabc", "unirio", "ufrj"]),
    ("Universidade Estadual (Outros Estados)", ["estadual", "udesc", "unioeste", "uem", "uern", "uel"]),
    ("Instituição Internacional / Exterior", ["québec", "illinois", "oxford", "leiden", "california", "ibero-amerikanisches"]),
    ("Órgão Público / Instituto de Pesquisa", ["ministério", "inep", "capes", "cnpq", "fiocruz", "ebserh", "secretaria", "confederação"]),
]
# Parts of names that mark a foreign institution, and production type labels.
FOREIGN = ["université", "university of", "universidad de", "universitat", "university, ", "oxford", "harvard", "sorbonne", "paris", "lyon", "coimbra", "porto", "lisboa", "buenos aires"]
TYPE_LABELS = {
    "ARTIGO": "Artigo", "LIVRO": "Livro", "CAPITULO": "Capítulo", "EVENTO": "Trabalho em evento", "TEXTO_JORNAL": "Texto em jornal ou revista", "TRABALHO_TECNICO": "Trabalho técnico", "OUTRA_TECNICA": "Produção técnica",
    "SOFTWARE": "Software", "PATENTE": "Patente", "MARCA": "Marca", "PRODUCAO_ARTISTICA": "Produção artística", "OUTRA": "Outra produção",
}


def canonical_course(raw: Column, name: Column) -> Column:
    """Raw is the course, name its normalised form (a column of its own); else title case; empty stays empty."""
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "").otherwise(rule_chain(name, COURSES, F.initcap(F.lower(F.trim(raw)))))


def institution_type(lower_name: Column) -> Column:
    """N9, of a lower-case name with its official name and acronym."""
    return rule_chain(lower_name, INSTITUTION_TYPES, F.lit("Privada / Comunitária / Outras"))


def type_label(c: Column) -> Column:
    """N27."""
    labels = F.create_map(*(F.lit(x) for kv in TYPE_LABELS.items() for x in kv))
    return F.coalesce(labels[c], F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" "))))


def initials(c: Column) -> Column:
    """The first letters of the first and last part of over two letters; of a name without such, its first two letters."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: F.length(p) > 2)
    letter = lambda p: F.substring(p, 1, 1)
    return F.upper(F.when(F.size(parts) == 0, F.substring(c, 1, 2)).when(F.size(parts) == 1, letter(F.get(parts, 0))).otherwise(F.concat(letter(F.get(parts, 0)), letter(F.element_at(parts, -1)))))


def affiliation_period(active: Column, start: Column, end: Column) -> Column:
    """N23: '2001–hoje', '1999–2010', 'até 2010', 'desde 1999' or null; years of 0 count as none."""
    a, b = (F.nullif(F.coalesce(x, F.lit(0)), F.lit(0)).cast("string") for x in (start, end))
    left = F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("–", a, b)).when(b.isNotNull(), F.concat(F.lit("até "), b)).otherwise(F.concat(F.lit("desde "), a))
    return F.when(active, F.concat(a, F.lit("–hoje"))).otherwise(left)


# Labels of project states, natures and kinds of funding.
PROJECT_STATUS = {"EM_ANDAMENTO": "Em andamento", "CONCLUIDO": "Concluído", "DESATIVADO": "Desativado"}
PROJECT_NATURE = {"PESQUISA": "Pesquisa", "EXTENSAO": "Extensão", "ENSINO": "Ensino", "DESENVOLVIMENTO": "Desenvolvimento", "OUTRA": "Outra"}
FUNDER_NATURE = {"AUXILIO_FINANCEIRO": "Auxílio financeiro", "BOLSA": "Bolsa", "COOPERACAO": "Cooperação", "REMUNERACAO": "Remuneração", "OUTRO": "Outro"}
NO_FUNDER_NATURE = "NAO_INFORMADO"


def _labelled(c: Column, labels: dict[str, str]) -> Column:
    text = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))
    plain = F.when(text == "", "Não informado").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text)))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.coalesce(c, F.lit(""))), plain)


def project_status(c: Column) -> Column:
    """N27."""
    return _labelled(c, PROJECT_STATUS)


def project_nature(c: Column) -> Column:
    """N27."""
    return _labelled(c, PROJECT_NATURE)


def funder_nature(c: Column) -> Column:
    """Null where it isn't stated."""
    return F.when((F.trim(F.coalesce(c, F.lit(""))) != "") & (c != NO_FUNDER_NATURE), _labelled(c, FUNDER_NATURE))


def project_period(start: Column, end: Column, status: Column) -> Column:
    """N27: '2019 – atual', '2015 – 2018', '2020', 'Até 2018' or 'Ano não informado'."""
    a, b = start.cast("string"), end.cast("string")
    no_start = F.when(end.isNotNull(), F.concat(F.lit("Até "), b)).otherwise("Ano não informado")
    return F.when(start.isNull(), no_start).when(end.isNull(), F.when(status == "EM_ANDAMENTO", F.concat(a, F.lit(" – atual"))).otherwise(a)).when(start == end, a).otherwise(F.concat_ws(" – ", a, b))


def common_text(a: str, b: str) -> int:
    """Characters that two strings share: the longest common part, then the same to its left and right."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, at, bt = 0, 0, 0
        previous = [0] * (b1 - b0 + 1)
        for i in range(a0, a1):
            row = [0] * (b1 - b0 + 1)
            for j in range(b0, b1):
                if a[i] == b[j]:
                    row[j - b0 + 1] = n = previous[j - b0] + 1
                    if n > best:
                        best, at, bt = n, i - n + 1, j - n + 1
            previous = row
        if best:
            total += best
            todo += [(a0, at, b0, bt), (at + best, a1, bt + best, b1)]
    return total


@F.pandas_udf(DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Half Jaccard of words, half shared text over the mean length. No built-in function has the shared-text measure."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        u, v = set(x.split(" ")), set(y.split(" "))
        size = len(x) + len(y)
        return 0.5 * len(u & v) / len(u | v) + 0.5 * (2 * common_text(x, y) / size if size else 0.0)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# Parts of a normalised institution name that all must occur, and the short name; the first rule that fits wins.
TRAJECTORY = [
    ("UFSCar", [["sao carlos", "federal"], ["sao carlos", "ufscar"], ["ufscar"], ["departamento de engenharia de materiais"], ["escola de biblioteconomia e documentacao de sao carlos"]]),
    ("USP", [["universidade de sao paulo"], ["fflch"], ["fearp"], ["escola de engenharia de sao carlos"], ["escola de comunicacao e artes"], ["faculdade de educacao da usp"], ["escola superior de agricultura luiz de queiroz"], ["esalq"], ["fdrp"], ["sanfran"], ["ribeirao preto sp"], ["usp rp"]]),
    ("UNICAMP", [["unicamp"], ["estadual de campinas"]]),
    ("UNESP", [["unesp"], ["estadual paulista"], ["ilha solteira"], ["araraquara"], ["marilia"], ["rio claro"], ["bauru"], ["franca"], ["assis"], ["presidente prudente"], ["jaboticabal"], ["botucatu"], ["ibrc"]]),
    ("PUC-SP", [["puc sp"], ["pucsp"], ["pontificia", "sao paulo"]]),
    ("PUC-Campinas", [["puc campinas"], ["puccamp"], ["pontificia", "campinas"]]),
    ("PUC-Rio", [["puc rio"], ["puc rj"], ["pontificia", "rio de janeiro"]]),
    ("PUC-RS", [["puc rs"], ["pucrs"], ["pontificia", "rio grande do sul"]]),
    ("PUC-Minas", [["puc minas"], ["puc mg"], ["pontificia", "minas"]]),
    ("UFMG", [["ufmg"], ["federal de minas"]]),
    ("UFRJ", [["ufrj"], ["federal do rio de janeiro"], ["universidade do brasil"]]),
    ("UFSC", [["ufsc"], ["federal de santa catarina"]]),
    ("UFRGS", [["ufrgs"], ["federal do rio grande do sul"]]),
    ("UnB", [["unb"], ["universidade de brasilia"]]),
    ("UFPR", [["ufpr"], ["federal do parana"]]),
    ("UFU", [["ufu"], ["federal de uberlandia"]]),
    ("UFF", [["uff"], ["federal fluminense"]]),
    ("UFPE", [["ufpe"], ["federal de pernambuco"]]),
    ("UFBA", [["ufba"], ["federal da bahia"]]),
    ("UFPA", [["ufpa"], ["federal do para"]]),
    ("UFPB", [["ufpb"], ["federal da paraiba"]]),
    ("UFC", [["ufc"], ["federal do ceara"]]),
    ("UFSM", [["ufsm"], ["federal de santa maria"]]),
    ("UFMS", [["ufms"], ["federal de mato grosso do sul"]]),
    ("UFMT", [["ufmt"], ["federal de mato grosso"]]),
    ("UFG", [["ufg"], ["federal de goias"]]),
    ("UFAL", [["ufal"], ["federal de alagoas"]]),
    ("UNIFESP", [["unifesp"], ["federal de sao paulo"], ["paulista de medicina"]]),
    ("UNIMEP", [["unimep"], ["metodista de piracicaba"]]),
    ("Mackenzie", [["mackenzie"]]),
    ("UEL", [["uel"], ["estadual de londrina"]]),
    ("UEM", [["uem"], ["estadual de maringa"]]),
    ("UERJ", [["uerj"], ["estadual do rio de janeiro"]]),
    ("UNISO", [["uniso"], ["universidade de sorocaba"]]),
    ("UNIFRAN", [["unifran"], ["universidade de franca"]]),
    ("USF", [["usf"], ["universidade sao francisco"]]),
    ("FADISC", [["fadisc"], ["direito de sao carlos"]]),
    ("FESPSP", [["fespsp"], ["fundacao escola de sociologia e politica"]]),
    ("UNIVESP", [["univesp"]]),
]


def trajectory_institution(raw: Column, name: Column, foreign: list[tuple[str, list[str]]] = ()) -> Column:
    """Raw and its normalised form (a column of its own) to a short name; `foreign` are further rules, after the fixed ones.

    Else title case, cut to 27 characters and three dots beyond 30. An empty name is 'Não informado'.
    """
    title = F.initcap(F.lower(F.trim(raw)))
    out = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "Não informado")
    usp = (name == "usp") | F.startswith(name, F.lit("usp ")) | F.endswith(name, F.lit(" usp"))
    for short, ways in [*TRAJECTORY, *((s, [[n] for n in needles]) for s, needles in foreign)]:
        hit = usp if short == "USP" else F.lit(False)
        for way in ways:
            both = F.lit(True)
            for n in way:
                both = both & F.contains(name, F.lit(n))
            hit = hit | both
        out = out.when(hit, short)
    return out.otherwise(F.when(F.length(title) > 30, F.concat(F.substring(title, 1, 27), F.lit("..."))).otherwise(title))
