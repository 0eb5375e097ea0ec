"""Curricula in XML and their child tables (inventory S3-S8, D1).

A curriculum has some hundred element names, and many sections are read by child, whatever its name. So each file is flattened,
where it lies, to one row for every item of every section, with its attributes as maps (`nodes`); what the items mean is then
plain columns: one function for each child table. All attributes stay strings until a table says otherwise.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAP, _MAPS = "map<string,string>", "array<map<string,string>>"
NODES = f"curriculum_id string, section string, tag string, pos int, item {_MAP}, basic {_MAP}, detail {_MAP}, first {_MAP}, authors {_MAPS}, keywords array<string>, members {_MAPS}, funders {_MAPS}"
# Sections whose items are the elements of these paths; a star takes every child.
SECTIONS = {
    "head": ["."], "education": ["DADOS-GERAIS/FORMACAO-ACADEMICA-TITULACAO/*"], "complementary": ["DADOS-COMPLEMENTARES/FORMACAO-COMPLEMENTAR/*"], "area": ["DADOS-GERAIS/AREAS-DE-ATUACAO/AREA-DE-ATUACAO"],
    "award": ["DADOS-GERAIS/PREMIOS-TITULOS/PREMIO-TITULO"], "language": ["DADOS-GERAIS/IDIOMAS/IDIOMA"], "project": ["DADOS-GERAIS//PROJETO-DE-PESQUISA"],
    "article": ["PRODUCAO-BIBLIOGRAFICA/ARTIGOS-PUBLICADOS/ARTIGO-PUBLICADO"], "book": ["PRODUCAO-BIBLIOGRAFICA/LIVROS-E-CAPITULOS/LIVROS-PUBLICADOS-OU-ORGANIZADOS/LIVRO-PUBLICADO-OU-ORGANIZADO"],
    "chapter": ["PRODUCAO-BIBLIOGRAFICA/LIVROS-E-CAPITULOS/CAPITULOS-DE-LIVROS-PUBLICADOS/CAPITULO-DE-LIVRO-PUBLICADO"], "event_work": ["PRODUCAO-BIBLIOGRAFICA/TRABALHOS-EM-EVENTOS/TRABALHO-EM-EVENTOS"],
    "newspaper": ["PRODUCAO-BIBLIOGRAFICA/TEXTOS-EM-JORNAIS-OU-REVISTAS/TEXTO-EM-JORNAL-OU-REVISTA"], "bibliographic": ["PRODUCAO-BIBLIOGRAFICA/DEMAIS-TIPOS-DE-PRODUCAO-BIBLIOGRAFICA/*"],
    "accepted": ["PRODUCAO-BIBLIOGRAFICA/ARTIGOS-ACEITOS-PARA-PUBLICACAO/ARTIGO-ACEITO-PARA-PUBLICACAO"], "technical": ["PRODUCAO-TECNICA/*"], "other_technical": ["PRODUCAO-TECNICA/DEMAIS-TIPOS-DE-PRODUCAO-TECNICA/*"],
    "other_work": ["OUTRA-PRODUCAO/DEMAIS-TRABALHOS"], "artistic": ["OUTRA-PRODUCAO/PRODUCAO-ARTISTICA-CULTURAL/*"], "concluded": ["OUTRA-PRODUCAO/ORIENTACOES-CONCLUIDAS/*"],
    "ongoing": ["DADOS-COMPLEMENTARES/ORIENTACOES-EM-ANDAMENTO/*"], "ongoing_elsewhere": ["OUTRA-PRODUCAO/ORIENTACOES-EM-ANDAMENTO/*"],
    "board": ["DADOS-COMPLEMENTARES//PARTICIPACAO-EM-BANCA-TRABALHOS-CONCLUSAO/*", "DADOS-COMPLEMENTARES//PARTICIPACAO-EM-BANCA-DE-EXAME-QUALIFICACAO", "DADOS-COMPLEMENTARES//PARTICIPACAO-EM-BANCA-JULGADORA/*"],
    "participation": ["DADOS-COMPLEMENTARES/PARTICIPACAO-EM-EVENTOS-CONGRESSOS/*"],
}


def _rows(root: ET.Element, number: str) -> Iterator[tuple]:
    maps = lambda item, path: [dict(x.attrib) for x in item.findall(path)]
    for section, paths in SECTIONS.items():
        pos = 0
        for path in paths:
            for item in root.findall(path):
                children = list(item)
                named = lambda start: next((dict(c.attrib) for c in children if c.tag.startswith(start)), None)  # noqa: E731, B023
                words = next((c.attrib for c in children if c.tag == "PALAVRAS-CHAVE"), {})
                keywords = [w for i in range(1, 7) if (w := words.get(f"PALAVRA-CHAVE-{i}", "").strip())]
                general = item.find("DADOS-GERAIS") if section == "head" else None
                first = dict(general.attrib) if general is not None else dict(children[0].attrib) if children else None
                yield (
                    number, section, item.tag, pos, dict(item.attrib), named("DADOS-BASICOS"), named("DETALHAMENTO"), first, maps(item, "AUTORES"), keywords,
                    maps(item, "EQUIPE-DO-PROJETO/INTEGRANTES-DO-PROJETO"), maps(item, "FINANCIADORES-DO-PROJETO/FINANCIADOR-DO-PROJETO"),
                )
                pos += 1
    for pos, item in enumerate(root.findall("DADOS-GERAIS/ATUACOES-PROFISSIONAIS/ATUACAO-PROFISSIONAL")):
        for bond in item.findall("VINCULOS") or [None]:
            yield number, "experience", item.tag, pos, dict(item.attrib), None if bond is None else dict(bond.attrib), None, None, [], [], [], []


def curriculum_number(attribute: str, informed: str | None, path: str) -> str | None:
    """S3: the first of attribute, the caller's number and the file name's digits that has 16 digits."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return next((x for x in (attribute.strip(), informed or "", re.sub(r"\D", "", name)) if re.fullmatch(r"\d{16}", x)), None)


def nodes(spark: SparkSession, path: str, informed: str | None = None) -> DataFrame:
    """S3: one row for each item of each curriculum file under path. A file that is no curriculum, or has no number, gives no rows."""
    schema = pa.schema([("curriculum_id", pa.string()), ("section", pa.string()), ("tag", pa.string()), ("pos", pa.int32()), *((c, pa.map_(pa.string(), pa.string())) for c in ("item", "basic", "detail", "first")),
                        ("authors", pa.list_(pa.map_(pa.string(), pa.string()))), ("keywords", pa.list_(pa.string())), *((c, pa.list_(pa.map_(pa.string(), pa.string()))) for c in ("members", "funders"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                number = curriculum_number(root.get("NUMERO-IDENTIFICADOR", ""), informed, file) if root.tag == "CURRICULO-VITAE" else None
                if number:
                    rows = [tuple(list(v.items()) if isinstance(v, dict) else [list(m.items()) for m in v] if isinstance(v, list) and v and isinstance(v[0], dict) else v for v in r) for r in _rows(root, number)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, NODES)


# --- columns of the maps ---
def _first(where: str, *names: str) -> Column:
    """The first attribute that is there, trimmed; '' if none is."""
    return F.trim(F.coalesce(*(F.col(where)[n] for n in names), F.lit("")))


def _filled(where: str, *names: str) -> Column:
    """The first attribute that isn't empty, trimmed; '' if all are."""
    return F.coalesce(*(F.nullif(F.trim(F.col(where)[n]), F.lit("")) for n in names), F.lit(""))


def _number(c: Column) -> Column:
    """The leading digits as a number; null for none and for 0."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def _of(n: DataFrame, *sections: str) -> DataFrame:
    return n.where(F.col("section").isin(*sections))


def _cut(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def researchers(n: DataFrame) -> DataFrame:
    """One row a curriculum: names and the date of its update."""
    day = F.try_to_timestamp(F.col("item")["DATA-ATUALIZACAO"], F.lit("ddMMyyyy")).cast("date")
    return _of(n, "head").select("curriculum_id", _first("first", "NOME-COMPLETO").alias("full_name"), _first("first", "NOME-EM-CITACOES-BIBLIOGRAFICAS").alias("citation_names"), day.alias("updated"))


def profiles(n: DataFrame) -> DataFrame:
    """What a curriculum says about its owner; empty fields where it doesn't."""
    names = {"orcid": "ORCID-ID", "nationality": "PAIS-DE-NACIONALIDADE", "resume": "TEXTO-RESUMO-CV-RH", "work_address": "ENDERECO-PROFISSIONAL", "work_postal_code": "CEP", "work_phone": "TELEFONE", "work_city": "CIDADE", "work_state": "UF", "work_country": "PAIS"}
    return _of(n, "head").select("curriculum_id", *(_first("first", a).alias(c) for c, a in names.items()))


def educations(n: DataFrame) -> DataFrame:
    """Degrees, level by tag, and complementary courses in four levels."""
    short = F.when(F.contains("tag", F.lit("CURTA-DURACAO")), "CURTA_DURACAO").when(F.contains("tag", F.lit("EXTENSAO")), "EXTENSAO").when(F.contains("tag", F.lit("APERFEICOAMENTO")), "APERFEICOAMENTO").otherwise("COMPLEMENTAR")
    degree = F.col("section") == "education"
    course = F.when(degree, _first("item", "NOME-CURSO", "NOME-DO-CURSO", "TITULO-DO-TRABALHO")).otherwise(_first("item", "NOME-CURSO", "NOME-DO-CURSO"))
    end = F.when(degree, _filled("item", "ANO-DE-CONCLUSAO", "ANO-DE-OBTENCAO-DO-TITULO")).otherwise(_first("item", "ANO-DE-CONCLUSAO"))
    return _of(n, "education", "complementary").select(
        "curriculum_id", F.when(degree, F.col("tag")).otherwise(short).alias("level"), _cut(course, 255).alias("course_name"), _cut(_first("item", "NOME-INSTITUICAO", "NOME-DA-INSTITUICAO"), 255).alias("institution_name"),
        _number(_first("item", "ANO-DE-INICIO")).alias("start_year"), _number(end).alias("end_year"),
        F.when(degree, _filled("item", "TITULO-DA-DISSERTACAO-TESE", "TITULO-DO-TRABALHO-DE-CONCLUSAO-DE-CURSO", "TITULO-DO-TRABALHO", "TITULO-DA-MONOGRAFIA")).alias("monograph_title"),
        F.when(degree, _cut(_filled("item", "NOME-COMPLETO-DO-ORIENTADOR", "NOME-DO-ORIENTADOR", "NOME-ORIENTADOR-DOUT"), 255)).alias("advisor_name"), F.when(degree, _cut(_filled("item", "NOME-AGENCIA"), 150)).alias("granting_agency"),
        _number(_first("item", "CARGA-HORARIA")).alias("workload_hours"),
    )


def experiences(n: DataFrame, as_of: str) -> DataFrame:
    """One row for each bond of each institution, or one without bond. `LIVRE` stands for the other field, or for nothing; current without end, or if its
    month (December without one) isn't before as_of, yyyy-mm."""
    free = lambda *names: F.when(F.upper(_first("basic", *names)) == "LIVRE", "").otherwise(_first("basic", *names))
    named = lambda own, *general: F.when(free(own) != "", free(own)).otherwise(free(*general))
    end, month = _number(_first("basic", "ANO-FIM")), _number(_first("basic", "MES-FIM"))
    until = F.format_string("%04d-%02d", end, F.coalesce(month, F.lit(12)))
    flag = lambda c: F.upper(_first("basic", c)) == "SIM"
    bond = F.col("basic").isNotNull()
    return _of(n, "experience").where(_first("item", "NOME-INSTITUICAO") != "").select(
        "curriculum_id", _cut(_first("item", "NOME-INSTITUICAO"), 255).alias("institution_name"), _first("item", "CODIGO-INSTITUICAO").alias("institution_code"),
        F.when(bond, named("OUTRO-ENQUADRAMENTO-FUNCIONAL-INFORMADO", "ENQUADRAMENTO-FUNCIONAL")).alias("role_name"), F.when(bond, named("OUTRO-VINCULO-INFORMADO", "TIPO-DE-VINCULO", "TIPO-VINCULO")).alias("contract_type"),
        _number(_first("basic", "ANO-INICIO")).alias("start_year"), end.alias("end_year"), _number(_first("basic", "MES-INICIO")).alias("start_month"), month.alias("end_month"),
        F.when(bond, end.isNull() | (until >= as_of)).otherwise(F.lit(False)).alias("is_current"), _number(_first("basic", "CARGA-HORARIA-SEMANAL")).alias("workload_hours"),
        (bond & flag("FLAG-DEDICACAO-EXCLUSIVA")).alias("is_exclusive_dedication"),
    )


def knowledge_areas(n: DataFrame) -> DataFrame:
    """S4."""
    names = {"major_area": "NOME-GRANDE-AREA-DO-CONHECIMENTO", "area": "NOME-DA-AREA-DO-CONHECIMENTO", "sub_area": "NOME-DA-SUB-AREA-DO-CONHECIMENTO", "specialty": "NOME-DA-ESPECIALIDADE"}
    return _of(n, "area").select("curriculum_id", *(_first("item", a).alias(c) for c, a in names.items()))


def awards(n: DataFrame) -> DataFrame:
    """Awards that have a name."""
    name = _first("item", "NOME-DO-PREMIO-OU-TITULO")
    return _of(n, "award").where(name != "").select("curriculum_id", name.alias("name"), _first("item", "NOME-DA-ENTIDADE-PROMOTORA").alias("promoter"), _number(_first("item", "ANO-DA-PREMIACAO")).alias("year"))


def languages(n: DataFrame) -> DataFrame:
    """Languages that have a name."""
    name = _filled("item", "DESCRICAO-DO-IDIOMA", "IDIOMA")
    skills = {"reading": "LEITURA", "writing": "ESCRITA", "speaking": "FALA", "comprehension": "COMPREENSAO"}
    return _of(n, "language").where(name != "").select("curriculum_id", name.alias("language"), *(_first("item", f"PROFICIENCIA-DE-{a}").alias(c) for c, a in skills.items()))


# Technical tags with a type of their own.
TECHNICAL_TAGS = ("SOFTWARE", "PATENTE", "MARCA")
#: The sections of productions, with their type.
PRODUCTIONS = {"article": "ARTIGO", "book": "LIVRO", "chapter": "CAPITULO", "event_work": "EVENTO", "newspaper": "TEXTO_JORNAL", "bibliographic": "OUTRA", "accepted": "OUTRA", "other_work": "OUTRA", "other_technical": "OUTRA_TECNICA", "artistic": "PRODUCAO_ARTISTICA"}


def productions(n: DataFrame) -> DataFrame:
    """All productions in one table, with authors in order, keywords and page range.

    Accepted articles are OUTRA, so never counted as articles; the wrapper of further technical works is no work itself. Items without
    basic data are left out, and so are untitled ones of the sections that ask for a title.
    """
    section = F.col("section")
    by_first = section.isin("bibliographic", "technical", "other_technical")
    data = F.when(by_first, F.col("first")).otherwise(F.col("basic"))
    p = _of(n, *PRODUCTIONS, "technical").where(data.isNotNull() & ~((section == "technical") & (F.col("tag") == "DEMAIS-TIPOS-DE-PRODUCAO-TECNICA")))
    p = p.withColumn("d", F.when(by_first, F.col("first")).otherwise(F.col("basic"))).withColumn("e", F.coalesce("detail", F.create_map().cast(_MAP)))
    types = F.create_map(*(F.lit(x) for kv in PRODUCTIONS.items() for x in kv))
    kind = F.when(section == "technical", F.when(F.col("tag").isin(*TECHNICAL_TAGS), F.col("tag")).otherwise("TRABALHO_TECNICO")).otherwise(types[section])
    technical = section.isin("technical", "other_technical")
    title = F.when(technical, _filled("d", "TITULO", "TITULO-DO-TRABALHO-TECNICO", "TITULO-DO-SOFTWARE", "TITULO-DO-PRODUTO", "TITULO-DO-PROCESSO")).otherwise(
        _first("d", "TITULO-DO-ARTIGO", "TITULO-DO-LIVRO", "TITULO-DO-CAPITULO-DO-LIVRO", "TITULO-DO-TEXTO", "TITULO", "TITULO-DO-TRABALHO", "TITULO-DA-OBRA-DE-ARTE-VISUAL"))
    nature = F.when(technical | (section == "bibliographic"), F.col("tag")).when(section == "accepted", "ARTIGO-ACEITO-PARA-PUBLICACAO").when(section.isin("book", "chapter"), _first("d", "TIPO", "NATUREZA"))
    nature = nature.otherwise(F.coalesce(F.col("d")["NATUREZA"], F.when(section == "other_work", F.lit("DEMAIS-TRABALHOS")).when(section == "artistic", F.col("tag")), F.lit("")))
    pages = F.nullif(F.array_join(F.filter(F.array(_first("e", "PAGINA-INICIAL"), _first("e", "PAGINA-FINAL")), lambda x: x != ""), "-"), F.lit(""))
    authors = F.transform(
        "authors",
        lambda a: F.struct(
            F.nullif(F.coalesce(a["ORDEM-DE-AUTORIA"].try_cast("int"), F.lit(0)), F.lit(0)).alias("author_order"), F.trim(F.coalesce(a["NOME-COMPLETO-DO-AUTOR"], F.lit(""))).alias("author_name"),
            F.trim(F.coalesce(a["NOME-PARA-CITACAO"], F.lit(""))).alias("citation_name"), F.nullif(F.trim(F.coalesce(a["NRO-ID-CNPQ"], F.lit(""))), F.lit("")).alias("curriculum_id"),
        ),
    )
    asks = section.isin("bibliographic", "technical", "other_technical", "accepted", "other_work", "artistic")
    return p.where(~asks | (title != "")).select(
        "curriculum_id", "section", "pos", kind.alias("item_type"), title.alias("title"), _cut(nature, 100).alias("nature"), _number(_filled("d", "ANO", "ANO-DO-ARTIGO", "ANO-DO-TRABALHO", "ANO-DO-TEXTO", "ANO-DESENVOLVIMENTO")).alias("year"),
        F.nullif(_first("d", "DOI"), F.lit("")).alias("doi"), _first("d", "IDIOMA").alias("language"), _first("d", "PAIS-DE-PUBLICACAO", "PAIS-DO-EVENTO", "PAIS").alias("country"),
        F.when(section == "chapter", _first("e", "TITULO-DO-LIVRO")).otherwise(_first("e", "TITULO-DO-PERIODICO-OU-REVISTA", "TITULO-DO-JORNAL-OU-REVISTA")).alias("journal_name"), F.nullif(_first("e", "ISSN"), F.lit("")).alias("issn"),
        F.nullif(_first("e", "ISBN"), F.lit("")).alias("isbn"), _first("e", "NOME-DA-EDITORA").alias("publisher"), _first("e", "NOME-DO-EVENTO").alias("event_name"), _first("e", "CIDADE-DO-EVENTO").alias("event_city"),
        _first("e", "VOLUME").alias("volume"), _first("e", "FASCICULO").alias("issue"), pages.alias("pages"), (_first("d", "FLAG-DIVULGACAO-CIENTIFICA") == "SIM").alias("is_scientific_dissemination"),
        "keywords", F.array_sort(authors).alias("authors"),
    )


# Orientation types by tag, and the words of the nature that tell them otherwise, in order.
ORIENTATION_TAGS = {
    "ORIENTACOES-CONCLUIDAS-PARA-MESTRADO": "MESTRADO", "ORIENTACOES-CONCLUIDAS-PARA-DOUTORADO": "DOUTORADO", "ORIENTACOES-CONCLUIDAS-PARA-POS-DOUTORADO": "POS_DOUTORADO", "ORIENTACAO-EM-ANDAMENTO-DE-MESTRADO": "MESTRADO",
    "ORIENTACAO-EM-ANDAMENTO-DE-DOUTORADO": "DOUTORADO", "ORIENTACAO-EM-ANDAMENTO-DE-POS-DOUTORADO": "POS_DOUTORADO", "ORIENTACAO-EM-ANDAMENTO-DE-INICIACAO-CIENTIFICA": "INICIACAO_CIENTIFICA",
    "ORIENTACAO-EM-ANDAMENTO-DE-GRADUACAO": "TCC_GRADUACAO", "ORIENTACAO-EM-ANDAMENTO-DE-APERFEICOAMENTO-ESPECIALIZACAO": "ESPECIALIZACAO",
}
ORIENTATION_WORDS = [("DOUTORADO", "DOUTORADO"), ("MESTRADO", "MESTRADO"), ("ESPECIALIZA|APERFEI[CÇ]OAMENTO", "ESPECIALIZACAO"), ("INICIA[CÇ][AÃ]O|PIBIC", "INICIACAO_CIENTIFICA"), ("GRADUA[CÇ][AÃ]O|CONCLUSAO_DE_CURSO|TCC", "TCC_GRADUACAO")]


def orientations(n: DataFrame) -> DataFrame:
    """Concluded and ongoing orientations that name a student; ongoing ones from the second place only where a curriculum has none in the first.

    The type follows the tag, else the first word that the nature holds: a post-doctorate told by its nature alone counts as doctorate.
    """
    first = _of(n, "ongoing").select("curriculum_id").distinct()
    rows = _of(n, "concluded", "ongoing").unionByName(_of(n, "ongoing_elsewhere").join(first, "curriculum_id", "left_anti")).where("basic IS NOT NULL")
    tags = F.create_map(*(F.lit(x) for kv in ORIENTATION_TAGS.items() for x in kv))
    said = F.upper(_first("basic", "NATUREZA"))
    kind = F.lit("OUTRA")
    for words, type_ in reversed(ORIENTATION_WORDS):
        kind = F.when(said.rlike(words), type_).otherwise(kind)
    done = F.col("section") == "concluded"
    title = F.when(done, _first("basic", "TITULO", "TITULO-DO-TRABALHO")).otherwise(_first("basic", "TITULO-DO-TRABALHO", "TITULO"))
    student = _first("detail", "NOME-DO-ORIENTADO", "NOME-DO-ORIENTANDO", "NOME-DO-BOLSISTA", "NOME-DO-CANDIDATO")
    return rows.where(student != "").select(
        "curriculum_id", F.coalesce(F.try_element_at(tags, F.col("tag")), kind).alias("orientation_type"), F.when(done, "CONCLUIDA").otherwise("EM_ANDAMENTO").alias("nature"), title.alias("title"), _number(_first("basic", "ANO")).alias("year"),
        _cut(student, 255).alias("student_name"), _cut(_first("detail", "NOME-DA-INSTITUICAO", "NOME-INSTITUICAO"), 255).alias("institution_name"), _cut(_first("detail", "NOME-DO-CURSO", "NOME-CURSO"), 255).alias("course_name"),
    )


def _yes(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("")))) == "SIM"


def projects(n: DataFrame) -> DataFrame:
    """Projects that have a name; coordinator if the team names the curriculum's owner as responsible; the first funder's name."""
    name = _first("item", "NOME-DO-PROJETO")
    leads = F.exists("members", lambda m: (m["NRO-ID-CNPQ"] == F.col("curriculum_id")) & _yes(m["FLAG-RESPONSAVEL"]))
    return _of(n, "project").where(name != "").select(
        "curriculum_id", "pos", _cut(name, 500).alias("name"), F.coalesce(F.col("item")["NATUREZA"], F.lit("PESQUISA")).alias("nature"), F.coalesce(F.col("item")["SITUACAO"], F.lit("EM_ANDAMENTO")).alias("status"),
        _number(_first("item", "ANO-INICIO")).alias("start_year"), _number(_first("item", "ANO-FIM")).alias("end_year"), _first("item", "DESCRICAO-DO-PROJETO").alias("description"), (F.coalesce(leads, F.lit(False)) | _yes(F.col("item")["FLAG-COORDENADOR"])).alias("is_coordinator"),
        F.trim(F.get("funders", 0)["NOME-INSTITUICAO"]).alias("agency_financier"),
    )


def project_members(n: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Members that have a name, with the researcher of their number, where people (curriculum_id, id) has it."""
    m = F.col("m")
    text = lambda a: F.trim(F.coalesce(m[a], F.lit("")))
    rows = _of(n, "project").where(_first("item", "NOME-DO-PROJETO") != "").select("curriculum_id", "pos", F.explode("members").alias("m")).where(text("NOME-COMPLETO") != "").select(
        "curriculum_id", "pos", _cut(text("NOME-COMPLETO"), 255).alias("full_name"), F.nullif(text("NOME-PARA-CITACAO"), F.lit("")).alias("citation_name"), _number(text("ORDEM-DE-INTEGRACAO")).alias("member_order"),
        _yes(m["FLAG-RESPONSAVEL"]).alias("is_responsible"), F.nullif(text("NRO-ID-CNPQ"), F.lit("")).alias("member_id"),
    )
    if people is None:
        return rows
    return rows.join(people.select(F.col("curriculum_id").alias("member_id"), F.col("id").alias("matched_researcher_id")), "member_id", "left")


def project_funders(n: DataFrame) -> DataFrame:
    """Funders that have a name or a code."""
    m = F.col("m")
    text = lambda a: F.trim(F.coalesce(m[a], F.lit("")))
    rows = _of(n, "project").where(_first("item", "NOME-DO-PROJETO") != "").select("curriculum_id", "pos", F.explode("funders").alias("m")).where((text("NOME-INSTITUICAO") != "") | (text("CODIGO-INSTITUICAO") != ""))
    return rows.select("curriculum_id", "pos", _cut(text("NOME-INSTITUICAO"), 255).alias("name"), F.nullif(text("CODIGO-INSTITUICAO"), F.lit("")).alias("institution_code"), F.nullif(text("NATUREZA"), F.lit("")).alias("nature"), _number(text("SEQUENCIA-FINANCIADOR")).alias("funder_order"))


# Parts of tags and what they name, in order.
BOARDS = [("DOUTORADO", "Doutorado"), ("MESTRADO", "Mestrado"), ("QUALIFICACAO", "Exame de Qualificação"), ("GRADUACAO", "Graduação"), ("CONCURSO", "Concurso Público"), ("AVALIACAO", "Avaliação de Curso")]
MEETINGS = [("CONGRESSO", "Congresso"), ("SIMPOSIO", "Simpósio"), ("SEMINARIO", "Seminário"), ("OFICINA", "Oficina"), ("ENCONTRO", "Encontro")]


def _by_tag(parts: list[tuple[str, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for part, name in reversed(parts):
        out = F.when(F.contains("tag", F.lit(part)), name).otherwise(out)
    return out


def boards(n: DataFrame) -> DataFrame:
    """Examination boards."""
    return _of(n, "board").select(
        "curriculum_id", _by_tag(BOARDS, "Banca Julgadora").alias("board_type"), _first("basic", "TITULO", "TITULO-DO-TRABALHO").alias("title"), _number(_first("basic", "ANO")).alias("year"),
        _first("detail", "NOME-DO-CANDIDATO").alias("candidate_name"), _first("detail", "NOME-DA-INSTITUICAO", "NOME-INSTITUICAO").alias("institution_name"),
    )


def participations(n: DataFrame) -> DataFrame:
    """Events attended that have a name, or a title of what was presented."""
    kind = F.when(F.startswith("tag", F.lit("OUTRAS-")), "Evento Científico").otherwise(_by_tag(MEETINGS, "Evento Científico"))
    title = F.coalesce(F.nullif(_first("basic", "TITULO", "TITULO-DA-APRESENTACAO-DO-TRABALHO"), F.lit("")), _first("detail", "TITULO-DA-APRESENTACAO-DO-TRABALHO"))
    rows = _of(n, "participation").select(
        "curriculum_id", kind.alias("event_type"), _first("detail", "NOME-DO-EVENTO").alias("e"), title.alias("presentation_title"), _first("basic", "TIPO-PARTICIPACAO", "FORMA-PARTICIPACAO").alias("participation_type"), _number(_first("basic", "ANO")).alias("year")
    )
    return rows.withColumn("event_name", F.coalesce(F.nullif("e", F.lit("")), "presentation_title")).where("event_name <> ''").drop("e")


def is_older(file_date: Column, stored_date: Column) -> Column:
    """Whether a file's ddmmyyyy is before the stored date; without one of the two it isn't."""
    return F.coalesce(F.try_to_timestamp(file_date, F.lit("ddMMyyyy")).cast("date") < stored_date, F.lit(False))
