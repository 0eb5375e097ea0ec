"""Curricula as web pages: the tables are those that the XML reader makes of the same person."""

import pytest
from pyspark.sql import functions as F

from quercus.sources import curriculum, curriculum_html

NUMBER = "1234567890123456"


def pair(label, text):
    return f'<div class="layout-cell layout-cell-3"><b>{label}</b></div><div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">{text}</div></div>'


def item(n, text):
    return f'<div class="layout-cell layout-cell-1"><b>{n}. </b></div><div class="layout-cell layout-cell-11"><span class="transform">{text}</span></div>'


def section(anchor, title, body):
    return f'<div class="title-wrapper"><a name="{anchor}"></a><h1>{title}</h1></div><div class="layout-cell layout-cell-12 data-cell">{body}</div>'


def listed(anchor, title, *texts):
    return f'<div class="cita-artigos"><b><a name="{anchor}"></a>{title}</b></div>' + "".join(item(i + 1, t) for i, t in enumerate(texts))


PAGE = (
    '<!DOCTYPE html><html><head><meta charset="iso-8859-1"></head><body><form><input type="hidden" name="id" value="K4123456A7"></form><div class="infpessoa"><h2 class="nome">Rita Amp&amp;atilde;ro  Dias</h2></div>'
    f'<ul class="informacoes-autor"><li>Endereço para acessar este CV: http://lattes.cnpq.br/{NUMBER}</li><li>Última atualização do currículo em 05/03/2024</li></ul>'
    '<p class="resumo">Professora de história. (Texto informado pelo autor)</p><a href="https://orcid.org/0000-0002-1825-009X">x</a>'
    + section("Identificacao", "Identificação", pair("Nome em citações bibliográficas", "DIAS, R. A.;DIAS, RITA") + pair("País de Nacionalidade", "Brasil"))
    + section("Endereco", "Endereço", pair("Endereço Profissional", "Universidade Modelo. Rua A, 10 - Centro, 13500-000 - Rio Claro, SP - Brasil. Telefone: (19) 1111-2222"))
    + section(
        "FormacaoAcademicaTitulacao", "Formação acadêmica/titulação",
        pair("2001 - 2005", "Doutorado em História Social.<br>Universidade Modelo, UM, Brasil.<br>Título: Portos e cidades.<br>Orientador: Ana Prado.<br>Bolsista do(a): CNPQ, Brasil.") + pair("1995 - 1999", "Graduação em História.<br>Faculdade Exemplo, FE, Brasil."),
    )
    + section("FormacaoAcademicaPosDoutorado", "Pós-doutorado", pair("2010 - 2011", "Pós-Doutorado.<br>Instituto Exemplo, IE, Brasil."))
    + section("FormacaoComplementar", "Formação Complementar", pair("2012 - 2012", "Arquivos digitais. (Carga horária: 12h).<br>Escola Livre, EL, Brasil."))
    + section("AtuacaoProfissional", "Atuação Profissional", '<div class="inst_back"><b>Universidade Modelo, UM, Brasil.</b></div>' + pair("03/2009 - Atual", "Vínculo: Servidor público, Enquadramento Funcional: Professor Doutor, Carga horária: 40, Regime: Dedicação exclusiva.") + pair("2005 - 02/2009", "Vínculo: Bolsista") + '<div class="inst_back"><b>Arquivo Municipal</b></div>')
    + section("ProjetosExtensao", "Projetos de extensão", pair("2013 - Atual", "Memória do bairro") + pair("", "Descrição: Recolher relatos. Situação: Concluído; Natureza: Extensão. Integrantes: Rita Dias - Coordenador / Léo Sá - Integrante. Financiador(es): CNPq - Auxílio financeiro.") + pair("2014 - 2015", "Outro") + pair("", "Situação: Em andamento"))
    + section("AreasAtuacao", "Áreas de atuação", pair("1.", "Grande área: Ciências Humanas / Área: História / Subárea: História do Brasil."))
    + section("Idiomas", "Idiomas", pair("Inglês", "Compreende Bem, Fala Pouco, Lê Bem, Escreve Razoavelmente."))
    + section("PremiosTitulos", "Prêmios e títulos", pair("2021", "Livro do ano, Academia Exemplo."))
    + '<div class="title-wrapper"><a name="ProducoesCientificas"></a><h1>Produções</h1></div><div id="artigos-completos"><div class="cita-artigos"><b><a name="ArtigosCompletos"></a>Artigos completos publicados em periódicos</b></div>'
    + "".join(
        f'<div class="artigo-completo">{item(i, t)}</div>'
        for i, t in enumerate(
            ['<a class="icone-producao icone-doi" href="http://dx.doi.org/10.1590/abc.1"></a>DIAS, R. A. ; <b>SÁ, L.</b> . Ruas e rios. REVISTA DE HISTÓRIA, v. 43, n. 2, p. 1-12, 2020.', "DIAS, R. A. . Editorial. REVISTA A, v. 1, p. 1-2, 2021.", "DIAS, R. A. . Editorial. REVISTA A, v. 2, p. 1-2, 2022."], 1
        )
    )
    + "</div>"
    + listed("LivrosCapitulos", "Livros publicados/organizados ou edições", "DIAS, R. A. (Org.) . Cidade velha. 1. ed. Rio Claro: Editora Exemplo, 2018. v. 1. 146p .")
    + listed("CapitulosLivros", "Capítulos de livros publicados", "DIAS, R. A. . Um porto. In: Portos do sul. 1. ed. Santos: Casa Exemplo, 2017. p. 67-80.")
    + listed("TextosJornaisRevistas", "Textos em jornais de notícias/revistas", "DIAS, R. A. . O arquivo aberto. Folha Local, Rio Claro, p. A3, 10 mar. 2019.")
    + listed("ResumosExpandidosAnaisCongresso", "Resumos expandidos publicados em anais de congressos", "DIAS, R. A. . Mapas antigos. In: Encontro de História, 2016, Santos. Anais... 2016.")
    + listed("AssessoriaConsultoria", "Assessoria e consultoria", "DIAS, R. A. . Parecer para o museu. 2015.")
    + listed("ProgramasComputador", "Programas de computador sem registro", "DIAS, R. A. . Indexador. 2014.")
    + section("OrientacoesConcluidas", "Orientações e supervisões concluídas", item(1, "João Reis. <b>Trilhos</b>. 2012. Dissertação (Mestrado em História) - Universidade Modelo. Orientador: Rita Dias.") + item(2, "Eva Luz. <b>Pontes</b>. 2013. Tese (Doutorado em História) - Universidade Modelo, CNPq."))
    + section("OrientacoesAndamento", "Orientações e supervisões em andamento", item(1, "Ivo Melo. Praças do sul. Início: 2023. Iniciação científica (Graduando em História) - Universidade Modelo."))
    + section("BancasTrabalhoConclusao", "Participação em bancas de trabalhos de conclusão", item(1, "DIAS, R. A.. Participação em banca de Caio Nunes. Vilas. 2011. Dissertação (Mestrado em História) - Universidade Modelo."))
    + section("ParticipacaoEventos", "Participação em eventos, congressos, exposições e feiras", item(1, "Simpósio de Arquivos. 2010. (Simpósio)."))
    + "</body></html>"
)

XML = f"""<CURRICULO-VITAE NUMERO-IDENTIFICADOR="{NUMBER}" DATA-ATUALIZACAO="05032024">
<DADOS-GERAIS NOME-COMPLETO="Rita Amp&amp;atilde;ro  Dias" NOME-EM-CITACOES-BIBLIOGRAFICAS="DIAS, R. A.;DIAS, RITA">
<FORMACAO-ACADEMICA-TITULACAO>
<DOUTORADO NOME-CURSO="História Social" NOME-INSTITUICAO="Universidade Modelo, UM, Brasil." ANO-DE-INICIO="2001" ANO-DE-CONCLUSAO="2005" TITULO-DA-DISSERTACAO-TESE="Portos e cidades" NOME-COMPLETO-DO-ORIENTADOR="Ana Prado" NOME-AGENCIA="CNPQ"/>
<GRADUACAO NOME-CURSO="História" NOME-INSTITUICAO="Faculdade Exemplo, FE, Brasil." ANO-DE-INICIO="1995" ANO-DE-CONCLUSAO="1999"/>
<POS-DOUTORADO NOME-CURSO="Pós-Doutorado" NOME-INSTITUICAO="Instituto Exemplo, IE, Brasil." ANO-DE-INICIO="2010" ANO-DE-CONCLUSAO="2011"/></FORMACAO-ACADEMICA-TITULACAO>
<ATUACOES-PROFISSIONAIS><ATUACAO-PROFISSIONAL NOME-INSTITUICAO="Universidade Modelo, UM, Brasil.">
<VINCULOS ANO-INICIO="2009" MES-INICIO="03" OUTRO-ENQUADRAMENTO-FUNCIONAL-INFORMADO="Professor Doutor" OUTRO-VINCULO-INFORMADO="Servidor público" CARGA-HORARIA-SEMANAL="40" FLAG-DEDICACAO-EXCLUSIVA="SIM"/>
<VINCULOS ANO-INICIO="2005" ANO-FIM="2009" MES-FIM="02" OUTRO-VINCULO-INFORMADO="Bolsista"/></ATUACAO-PROFISSIONAL><ATUACAO-PROFISSIONAL NOME-INSTITUICAO="Arquivo Municipal"/></ATUACOES-PROFISSIONAIS>
<AREAS-DE-ATUACAO><AREA-DE-ATUACAO NOME-GRANDE-AREA-DO-CONHECIMENTO="Ciências Humanas" NOME-DA-AREA-DO-CONHECIMENTO="História" NOME-DA-SUB-AREA-DO-CONHECIMENTO="História do Brasil"/></AREAS-DE-ATUACAO>
<IDIOMAS><IDIOMA IDIOMA="Inglês" PROFICIENCIA-DE-LEITURA="Bem" PROFICIENCIA-DE-ESCRITA="Razoavelmente" PROFICIENCIA-DE-FALA="Pouco" PROFICIENCIA-DE-COMPREENSAO="Bem"/></IDIOMAS>
<PREMIOS-TITULOS><PREMIO-TITULO NOME-DO-PREMIO-OU-TITULO="Livro do ano" NOME-DA-ENTIDADE-PROMOTORA="Academia Exemplo." ANO-DA-PREMIACAO="2021"/></PREMIOS-TITULOS>
<P><PROJETO-DE-PESQUISA NOME-DO-PROJETO="Memória do bairro" NATUREZA="EXTENSAO" SITUACAO="CONCLUIDO" ANO-INICIO="2013" DESCRICAO-DO-PROJETO="Recolher relatos." FLAG-COORDENADOR="SIM">
<EQUIPE-DO-PROJETO><INTEGRANTES-DO-PROJETO NOME-COMPLETO="Rita Dias" ORDEM-DE-INTEGRACAO="1" FLAG-RESPONSAVEL="SIM"/><INTEGRANTES-DO-PROJETO NOME-COMPLETO="Léo Sá" ORDEM-DE-INTEGRACAO="2" FLAG-RESPONSAVEL="NAO"/></EQUIPE-DO-PROJETO>
<FINANCIADORES-DO-PROJETO><FINANCIADOR-DO-PROJETO NOME-INSTITUICAO="CNPq" NATUREZA="Auxílio financeiro" SEQUENCIA-FINANCIADOR="1"/></FINANCIADORES-DO-PROJETO></PROJETO-DE-PESQUISA>
<PROJETO-DE-PESQUISA NOME-DO-PROJETO="Outro" NATUREZA="EXTENSAO" SITUACAO="EM_ANDAMENTO" ANO-INICIO="2014" ANO-FIM="2015"/></P>
</DADOS-GERAIS><DADOS-COMPLEMENTARES><FORMACAO-COMPLEMENTAR><FORMACAO-COMPLEMENTAR-CURTA-DURACAO NOME-CURSO="Arquivos digitais" NOME-INSTITUICAO="Escola Livre, EL, Brasil." ANO-DE-INICIO="2012" ANO-DE-CONCLUSAO="2012" CARGA-HORARIA="12"/></FORMACAO-COMPLEMENTAR></DADOS-COMPLEMENTARES></CURRICULO-VITAE>"""


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cv")
    (folder / "a.xml").write_text(XML)
    (folder / "a.html").write_bytes(PAGE.encode())
    html, _ = curriculum_html.stored_nodes(spark.read.format("binaryFile").load(f"file://{folder}/a.html").select("content"))
    return html, curriculum.nodes(spark, f"file://{folder}/a.xml")


def rows(df, *leave):
    return sorted(map(str, df.drop(*leave).collect()))


@pytest.mark.parametrize("table", ["researchers", "educations", "experiences", "knowledge_areas", "languages", "awards", "projects", "project_members", "project_funders"])
def test_same_tables(both, table):
    make = getattr(curriculum, table)
    args = ["2024-06"] if table == "experiences" else []
    html, xml = (rows(make(n, *args), "pos") for n in both)
    assert html == xml and html


def test_profile(both):
    r = curriculum.profiles(both[0]).first().asDict()
    assert r == {
        "curriculum_id": NUMBER, "orcid": "0000-0002-1825-009X", "nationality": "Brasil", "resume": "Professora de história.", "work_address": "Universidade Modelo. Rua A, 10 - Centro, 13500-000 - Rio Claro, SP - Brasil. Telefone: (19) 1111-2222", "work_postal_code": "13500-000",
        "work_phone": "(19) 1111-2222", "work_city": "Rio Claro", "work_state": "SP", "work_country": "Brasil",
    }


def test_works(both):
    p = curriculum.productions(both[0])
    got = sorted((r.item_type, r.title, r.year, r.journal_name or r.event_name or r.publisher, r.doi, r.volume, r.issue, r.pages, [a.author_name for a in r.authors]) for r in p.collect())
    assert got == sorted([
        ("ARTIGO", "Ruas e rios", 2020, "REVISTA DE HISTÓRIA", "10.1590/abc.1", "43", "2", "1-12", ["DIAS, R. A.", "SÁ, L"]), ("ARTIGO", "Editorial", 2021, "REVISTA A", None, "1", "", "1-2", ["DIAS, R. A"]), ("ARTIGO", "Editorial", 2022, "REVISTA A", None, "2", "", "1-2", ["DIAS, R. A"]),
        ("LIVRO", "Cidade velha", 2018, "Editora Exemplo", None, "1", "", None, ["DIAS, R. A."]), ("CAPITULO", "Um porto", 2017, "Portos do sul", None, "", "", "67-80", ["DIAS, R. A"]), ("TEXTO_JORNAL", "O arquivo aberto", 2019, "Folha Local", None, "", "", None, ["DIAS, R. A"]),
        ("EVENTO", "Mapas antigos", 2016, "Encontro de História", None, "", "", None, ["DIAS, R. A"]), ("TRABALHO_TECNICO", "Parecer para o museu", 2015, "", None, "", "", None, ["DIAS, R. A"]), ("SOFTWARE", "Indexador", 2014, "", None, "", "", None, ["DIAS, R. A"]),
    ])
    assert {r.nature for r in p.where("item_type = 'EVENTO'").collect()} == {"RESUMO_EXPANDIDO"} and {r.nature for r in p.where("item_type = 'TRABALHO_TECNICO'").collect()} == {"ASSESSORIA"}


def test_people(both):
    o = sorted((r.orientation_type, r.nature, r.title, r.year, r.student_name, r.institution_name) for r in curriculum.orientations(both[0]).collect())
    assert o == [
        ("DOUTORADO", "CONCLUIDA", "Pontes", 2013, "Eva Luz", "Universidade Modelo"), ("INICIACAO_CIENTIFICA", "EM_ANDAMENTO", "Praças do sul. Início: 2023. Iniciação científica (Graduando em História) - Universidade Modelo.", 2023, "Ivo Melo", "Universidade Modelo"),
        ("MESTRADO", "CONCLUIDA", "Trilhos", 2012, "João Reis", "Universidade Modelo"),
    ]
    b = curriculum.boards(both[0]).first()
    assert (b.board_type, b.year, b.candidate_name, b.institution_name) == ("Mestrado", 2011, "Caio Nunes", "Universidade Modelo")
    e = curriculum.participations(both[0]).first()
    assert (e.event_type, e.event_name, e.year, e.participation_type) == ("Simpósio", "Simpósio de Arquivos. 2010. (Simpósio).", 2010, "PARTICIPACAO")


def test_odd_pages(spark):
    """No number, nulls, unclosed elements, a page that ends within a tag, bytes in Latin-1, repeated pages."""
    broken = f'<div class="infpessoa"><h2 class="nome">A</h2><p>lattes.cnpq.br/{NUMBER}<div class="title-wrapper"><h1>Idiomas</h1></div><div class="data-cell"><div class="layout-cell-3">Grego<div class="layout-cell-9">Lê Bem'
    pages = spark.createDataFrame([(b"<p>nothing",), (None,), (broken.encode(),), (PAGE.encode("latin-1"),), (PAGE.encode(),), (b"",)], "content binary")
    n, _ = curriculum_html.stored_nodes(pages)
    assert sorted(r.full_name for r in curriculum.researchers(n).collect()) == ["A", "Rita Amp&atilde;ro  Dias", "Rita Amp&atilde;ro  Dias"]
    assert curriculum.productions(n).where("title = 'Ruas e rios'").count() == 1
    assert curriculum_html.nodes(pages.where(F.lit(False))).count() == 0


HEAD = f'<div class="infpessoa"><h2 class="nome">A</h2></div><ul><li>Endereço para acessar este CV: http://lattes.cnpq.br/{NUMBER}</li></ul>'


def test_years_of_theses(spark):
    """Years in titles and in students' names are not those of the theses."""
    page = (
        HEAD
        + section("OrientacoesConcluidas", "Orientações e supervisões concluídas", item(1, "Aluno 1900. <b>Tema 1901</b>. 2003. Dissertação (Mestrado em Letras) - Universidade Modelo.") + item(2, "Eva Luz. O ano 1922, 1923. 2013. Tese (Doutorado em História) - Universidade Modelo."))
        + section("OrientacoesAndamento", "Orientações e supervisões em andamento", item(1, "Ivo Melo. Praças de 1930. Início: 2023. Iniciação científica (Graduando em História) - Universidade Modelo."))
        + section("BancasTrabalhoConclusao", "Participação em bancas de trabalhos de conclusão", item(1, "DIAS, R. A.. Participação em banca de Caio Nunes. Vilas de 1908. 2011. Dissertação (Mestrado em História) - Universidade Modelo."))
        + section("ParticipacaoEventos", "Participação em eventos, congressos, exposições e feiras", item(1, "Simpósio 1989 de Arquivos. 2010. (Simpósio)."))
    )
    n, _ = curriculum_html.stored_nodes(spark.createDataFrame([(page,)], "content string"))
    assert sorted((r.student_name, r.year) for r in curriculum.orientations(n).collect()) == [("Aluno 1900", 2003), ("Eva Luz", 2013), ("Ivo Melo", 2023)]
    assert curriculum.boards(n).first().year == 2011 and curriculum.participations(n).first().year == 2010


#: Items whose titles and names hold years, with the year that is said of them.
WORK_YEARS = [
    ("ArtigosCompletos", "Artigos completos publicados em periódicos", "DIAS, R. A. . Um artigo da página 1900. REVISTA A, v. 3, n. 2, p. 1-10, 2000.", 2000), ("ArtigosCompletos", "Artigos completos publicados em periódicos", "DIAS, R. A. . Brasil, 1964. Cadernos 1970, v. 2001, p. 1990, 2002.", 2002),
    ("LivrosCapitulos", "Livros publicados/organizados ou edições", "DIAS, R. A. . A revolta de 1904. 1. ed. Santos: Casa Exemplo, 2018. v. 1. 146p .", 2018), ("CapitulosLivros", "Capítulos de livros publicados", "DIAS, R. A. . Meio século. In: Livro 1950. 1. ed. Santos: Casa Exemplo, 2001. p. 1990-1999.", 2001),
    ("TextosJornaisRevistas", "Textos em jornais de notícias/revistas", "DIAS, R. A. . Lembrar 1968. Folha Local, Rio Claro, p. A3, 10 mar. 2019.", 2019), ("ResumosExpandidosAnaisCongresso", "Resumos expandidos publicados em anais de congressos", "DIAS, R. A. . Mapas de 1822 a 1922. In: Encontro de História, 2016, Santos. Anais... 2017.", 2016),
    ("AssessoriaConsultoria", "Assessoria e consultoria", "DIAS, R. A. . Parecer sobre o plano 2030. 2015.", 2015), ("AssessoriaConsultoria", "Assessoria e consultoria", "DIAS, R. A. . Parecer de março de 1999", 1999),
]


def test_years_of_works(spark):
    """Years in titles, pages and the names of books and journals are not those of the works."""
    n, _ = curriculum_html.stored_nodes(spark.createDataFrame([(HEAD + "".join(listed(a, t, x) for a, t, x, _ in WORK_YEARS),)], "content string"))
    assert [r.year for r in curriculum.productions(n).orderBy("pos").collect()] == [y for *_, y in WORK_YEARS]
