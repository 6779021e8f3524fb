"""Registered queries that read texts: snippets, search results, classes, fees, prospecting; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastro.functions import text as T
from lastro.operators import classify, export, prospect, search
from lastro.plans import driver_tables as D
from lastro.plans.catalog import CURRENT, FOUND, FUND_FILTERS, FUND_WHERE, LANGS, TEXT_FILTERS, query

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tidy(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'), ' ')"


def cut(words: dict[str, int], most: int, of: str = D.TEXTS, context: int = 160) -> str:
    """Rows id_fnet, n, a, lead, hit, tail, flagged of each text's first matches of single-word terms: words gives each form's term."""
    forms = ", ".join(f"('{w}', {k})" for w, k in words.items())
    before, flags = "greatest(a - {0}, 0)", "|".join(T.PROHIBITIONS)
    near, far = before.format(T.PROHIBITION_WINDOW), before.format(context)
    return f"""(WITH t AS (SELECT * FROM {of}),
w AS (SELECT id_fnet, regexp_extract_all(texto_norm, '[0-9a-z]+') AS ws, regexp_split_to_array(texto_norm, '[0-9a-z]+') AS gs FROM t),
u AS (SELECT id_fnet, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT id_fnet, word, sum(len(gap) + len(word)) OVER (PARTITION BY id_fnet ORDER BY i) AS b FROM u),
h AS (SELECT id_fnet, CAST(b - len(word) AS INTEGER) AS a, CAST(b AS INTEGER) AS b, row_number() OVER (PARTITION BY id_fnet ORDER BY k, b) AS n FROM p JOIN (VALUES {forms}) AS v(form, k) ON word = form),
c AS (SELECT id_fnet, n, a, {tidy(f"substr(texto, {far} + 1, a - {far})")} AS before, {tidy("substr(texto, a + 1, b - a)")} AS hit, {tidy(f"substr(texto, b + 1, {context})")} AS after,
regexp_matches(regexp_replace(substr(texto_norm, {near} + 1, a - {near}), '{SPACES}', ' ', 'g'), '{flags}') AS flagged FROM h JOIN t USING (id_fnet) WHERE n <= {most})
SELECT id_fnet, n, a, CASE WHEN before <> '' THEN before || ' ' ELSE '' END AS lead, hit, CASE WHEN after <> '' THEN ' ' || after ELSE '' END AS tail, flagged FROM c)"""


SNIPPET = "lead || hit || tail AS texto, hit AS match, CAST(len(lead) AS INTEGER) AS inicio, CAST(len(lead) + len(hit) AS INTEGER) AS fim, a AS posicao_documento, flagged AS possivel_vedacao"
LICENSE, THE, LITERAL = {"license": 0, "licenses": 0}, {"the": 1, "thes": 1}, {"the": 0}


# Snippets


@query(f"SELECT id_fnet, {SNIPPET} FROM {cut(LICENSE | THE, 3)}")
def snippets_top3(spark, d):
    out = T.snippets(D.texts(spark, d), "texto", "texto_norm", ["license", "the"], most=3)
    return T.snippet_rows(out, "id_fnet")


@query(f"SELECT id_fnet, lead || '«' || hit || '»' || tail AS destaque FROM {cut(THE, 1)}")
def highlight(spark, d):
    rows = T.snippets(D.texts(spark, d).filter(T.has_term(F.col("texto_norm"), "the")), "texto", "texto_norm", ["the"], most=1)
    return rows.select("id_fnet", T.highlighted(F.col("trechos")[0]).alias("destaque"))


@query(f"SELECT d.id_fnet, cnpj, {SNIPPET} FROM {D.DOCUMENTS} d JOIN {cut(THE, 10, f'(SELECT * FROM {D.TEXTS} WHERE id_fnet = 7)')} t ON d.id_fnet = t.id_fnet WHERE d.id_fnet = 7")
def document_page(spark, d):
    return T.snippet_rows(search.document_page(D.documents(spark, d), D.texts(spark, d), 7, ["the"]), "id_fnet", "cnpj")


@query(f"SELECT doc_id, {tidy('text')} AS texto FROM documents")
def collapse_text(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("texto"))


# Search


@query(f"SELECT cnpj, CAST(count(*) AS INTEGER) AS n_documentos FROM (SELECT id_fnet, bool_and(flagged) AS flagged FROM {cut(LICENSE, 3)} GROUP BY id_fnet) x JOIN {D.DOCUMENTS} d USING (id_fnet) JOIN {D.FUNDS} f USING (cnpj) WHERE NOT flagged AND d.categoria IN ('en','fr','de','es') GROUP BY cnpj")
def exclude_prohibited(spark, d):
    f = search.Filters(termos=("license",), categorias_documento=LANGS, excluir_vedacoes=True, apenas_vigente=False)
    return search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), f).select("cnpj", F.size("documentos").alias("n_documentos"))


@query(f"SELECT cnpj, CAST(count(*) AS BIGINT) AS n FROM {FOUND} AND {FUND_WHERE.replace('cnpj', 'f.cnpj')} GROUP BY cnpj")
def filtered_text_search(spark, d):
    f = search.Filters(**{**FUND_FILTERS.__dict__, "termos": ("the",), "categorias_documento": LANGS, "literal": True})
    out = search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), f)
    return out.select("cnpj", F.size("documentos").cast("bigint").alias("n"))


@query(f"SELECT DISTINCT cnpj, pl_medio_12m FROM {FOUND} ORDER BY pl_medio_12m DESC NULLS LAST, cnpj LIMIT 10 OFFSET 5")
def page_of_groups(spark, d):
    found = search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), TEXT_FILTERS)
    return search.page(found, search.Filters(limite=10, offset=5)).select("cnpj", "pl_medio_12m")


@query(f"SELECT count(*) AS total FROM {D.FUNDS} f LEFT JOIN {D.METRICS} m USING (cnpj) WHERE {FUND_WHERE}")
def count_funds(spark, d):
    return search.totals(search.funds_with_metrics(D.funds(spark, d), D.metrics(spark, d), FUND_FILTERS))


@query(f"SELECT f.cnpj FROM {D.FUNDS} f LEFT JOIN {D.METRICS} m USING (cnpj) WHERE {FUND_WHERE} ORDER BY pl_medio_12m DESC NULLS LAST, f.cnpj LIMIT 200 OFFSET 3")
def query_string_search(spark, d):
    f = search.filters_from_query("?tipo=FII,FIDC&publico=build&publico=auto&situacao=em%20funcionamento%20normal&plMin=50000&cotistasMax=900&limite=999&offset=3")
    return search.search_funds(D.funds(spark, d), D.metrics(spark, d), f).select("cnpj")


@query(f"SELECT cnpj, competencia, pl, num_cotistas FROM {D.REPORTS} WHERE cnpj = '00000000000007' ORDER BY competencia")
def series(spark, d):
    return search.series(D.reports(spark, d), "00000000000007")


# Export


def text_of(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '')"


CELLS = {
    **{c: text_of(c) for c in ("cnpj", "denominacao", "tipo_veiculo", "publico_alvo", "situacao")}, **dict.fromkeys(("administrador", "gestor", "segmento"), "''"),
    **{c: text_of(c) for c in ("pl_atual", "pl_medio_12m", "cotistas_atual", "competencia_ultima")}, "documento_id": text_of("id_fnet"), "documento_categoria": text_of("categoria"), "documento_data_referencia": "'2024-01-01'",
    "documento_url": f"'{classify.DOCUMENT_URL}' || id_fnet", "possivel_vedacao": "CASE WHEN flagged THEN 'sim' ELSE 'nao' END", "trechos": "trechos",
}
EXPORTED = f"(SELECT * FROM {D.FUNDS} f JOIN {CURRENT} c USING (cnpj) JOIN (SELECT id_fnet, string_agg(lead || hit || tail, ' ||| ' ORDER BY n) AS trechos, bool_and(flagged) AS flagged FROM {cut(LITERAL, 3)} GROUP BY id_fnet) t USING (id_fnet) LEFT JOIN {D.METRICS} m USING (cnpj))"


@query(f"SELECT {', '.join(f'{e} AS {c}' for c, e in CELLS.items())} FROM {EXPORTED}")
def export_rows(spark, d):
    return export.export_rows(search.search_text(D.funds(spark, d), D.metrics(spark, d), D.documents(spark, d), D.texts(spark, d), TEXT_FILTERS))


def quoted(cell: str) -> str:
    return f"""CASE WHEN regexp_matches({cell}, '[";\\n\\r]') THEN '"' || replace({cell}, '"', '""') || '"' ELSE {cell} END"""


@query(f"SELECT {quoted('page_id || chr(59) || url')} || ';' || {quoted('url')} || ';' || {quoted('html')} AS value FROM pages")
def csv_lines(spark, d):
    rows = D.read(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(";"), "url").alias("a"), "url", "html")
    return export.csv_lines(rows)


@query(f"SELECT CAST(to_json({{'cnpj': cnpj, 'denominacao': denominacao, 'tipo_veiculo': tipo_veiculo, 'publico_alvo': publico_alvo, 'situacao': situacao}}) AS VARCHAR) AS value FROM {D.FUNDS}")
def json_rows(spark, d):
    return export.json_rows(D.funds(spark, d))


# Documents' contents


LEADS = ("Fundo 11.222.333/0001-81 adm 00.000.000/0001-91 ", "Fundo 11222333000181 ", "Fundo 11.222.333/0001-82 ", "")


def led(leads: tuple[str, ...]) -> str:
    """The texts with one of these sentences before each."""
    return f"(SELECT id_fnet, {list(leads)}[id_fnet % {len(leads)} + 1] || texto AS texto FROM {D.TEXTS})"


def lead(leads: tuple[str, ...]):
    return F.element_at(F.lit(list(leads)), (F.col("id_fnet") % len(leads) + 1).cast("int"))


#: A registration number, its check digits' weights; a sign between two numbers is doubled first, as each number needs one of its own.
NUMBER = r"(?:^|[^0-9])([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2})(?:$|[^0-9])"
WEIGHTS = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def numbers(text: str) -> str:
    return f"""regexp_extract_all(regexp_replace({text}, '([^0-9./-])', '\\1\\1', 'g'), '{NUMBER}', 1)"""


def digit(n: int) -> str:
    total = " + ".join(f"CAST(c[{i + 1}] AS INTEGER) * {w}" for i, w in enumerate(WEIGHTS[-n:]))
    return f"c[{n + 1}] = CAST(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END AS VARCHAR)"


@query(f"""WITH h AS (SELECT id_fnet, {numbers(f"substr(texto, 1, {prospect.PREAMBLE})")} AS hits FROM {led(LEADS)}),
e AS (SELECT id_fnet, unnest(range(len(hits))) AS pos, regexp_replace(unnest(hits), '[^0-9]', '', 'g') AS c FROM h),
v AS (SELECT * FROM e WHERE {digit(12)} AND {digit(13)} AND c <> repeat(c[1], 14))
SELECT id_fnet, arg_min(v.cnpj, (CASE WHEN f.cnpj IS NULL THEN 1 ELSE 0 END, pos)) AS cnpj FROM (SELECT id_fnet, pos, c AS cnpj FROM v) v LEFT JOIN (SELECT DISTINCT cnpj FROM {D.FUNDS}) f USING (cnpj) GROUP BY id_fnet""")
def text_cnpj(spark, d):
    """A number that the registry has, a valid one, one with wrong digits, none."""
    return prospect.text_cnpj(D.texts(spark, d).withColumn("texto", F.concat(lead(LEADS), "texto")), D.funds(spark, d))


#: What names one assignor, what several, both ways of defining them, both at once, nothing.
ASSIGNORS = ("Fundo com cedente único. ", "Fundo multicedente com diversos cedentes. ", "“Cedente”: quaisquer pessoas. ", "Cedentes significam 11.222.333/0001-81 ", "Monocedente ou multicedente. ", "Nada. ")
SPACED = SPACES.removesuffix("+")
DEFINED = f"[\"''“”‘’«»]?cedentes?[\"''“”‘’«»]?{SPACED}*(?::|-|–|—|significam?\\b)"


def said(words: tuple[str, ...]) -> str:
    return " + ".join(f"(len(x) - len(replace(x, '{w}', ''))) // {len(w)}" for w in words)


@query(f"""WITH t AS (SELECT id_fnet, lower(strip_accents(texto)) AS x FROM {led(ASSIGNORS)}),
m AS (SELECT id_fnet, x, CAST({said(classify.SINGLE_TERMS)} AS INTEGER) AS one, CAST({said(classify.SEVERAL_TERMS)} AS INTEGER) AS many, regexp_extract_all(x, '{DEFINED}') AS hits, regexp_split_to_array(x, '{DEFINED}') AS gaps FROM t),
p AS (SELECT *, unnest(range(1, least(len(hits), 3) + 1)) AS i FROM m),
w AS (SELECT id_fnet, substr(x, 1 + CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: len(g))), 0) AS BIGINT), len(hits[i]) + {classify.DEFINITION_WINDOW}) AS d FROM p),
s AS (SELECT id_fnet, bool_or(len({numbers("d")}) > 0) AS number, bool_or(regexp_matches(d, '{classify.GENERIC}')) AS generic FROM w GROUP BY id_fnet)
SELECT id_fnet, CASE WHEN one > 0 AND many = 0 THEN 'monocedente' WHEN many > 0 AND one = 0 THEN 'multicedente' WHEN number THEN 'monocedente' WHEN generic THEN 'multicedente' WHEN one > 0 THEN 'ambiguo' ELSE 'indeterminado' END AS classificacao,
CASE WHEN (one > 0) <> (many > 0) THEN 'termo explicito no regulamento' WHEN number OR generic THEN 'definicao de Cedente(s)' WHEN one > 0 THEN 'termos conflitantes' ELSE '' END AS fonte, one AS mencoes_mono, many AS mencoes_multi
FROM m LEFT JOIN s USING (id_fnet)""")
def cedente_class(spark, d):
    rows = D.texts(spark, d).withColumn("texto", F.concat(lead(ASSIGNORS), "texto")).withColumn("texto_norm", T.fold(F.col("texto")))
    return classify.assignor_class(rows).select("id_fnet", "classificacao", "fonte", "mencoes_mono", "mencoes_multi")


#: A clause of each kind, from the row's number; the SQL then reads it out of the text again.
CLAUSE = """CASE WHEN id_fnet % 11 = 0 THEN '' ELSE 'taxa de consultoria de ' || (id_fnet % 7) || ',' || (10 + id_fnet % 90) || '% ' || ['ao ano', '(zero) a.a.', 'sobre o patrimonio'][id_fnet % 3 + 1]
|| CASE WHEN id_fnet % 4 < 3 THEN [', minimo mensal', ', mensal fixo', ', unico'][id_fnet % 4 + 1] || ' de r$ ' || (id_fnet % 50) || '.500,00' ELSE '' END || CASE WHEN id_fnet % 5 = 0 THEN ' e remuneracao variavel' ELSE '' END || '; despesas do fundo 9% r$ 1,00 ' END"""
ENDED = r"(?:^|[^0-9,.])([0-9]{1,2}(?:[.,][0-9]{1,4})?)\s*$"
TERMS = ", ".join(f"({k}, '{t}')" for k, t in enumerate(classify.CONSULTING_TERMS))
KINDS = ("pct_aa", "pct_sem_periodo", "minimos_mensais", "fixos_mensais", "outros_valores")
LISTS = ", ".join(f"list(value ORDER BY place) FILTER (kind = '{k}') AS {k}" for k in KINDS)


@query(f"""WITH t AS (SELECT id_fnet, {CLAUSE} || texto_norm AS x FROM {D.TEXTS}),
w AS (SELECT id_fnet, x, k, len(term) AS size, string_split(x, term) AS gaps FROM t JOIN (VALUES {TERMS}) AS v(k, term) ON contains(x, term)),
o AS (SELECT *, unnest(range(1, len(gaps))) AS i FROM w),
r AS (SELECT id_fnet, k, i, substr(x, 1 + CAST(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + i * size AS BIGINT), {classify.CLAUSE_WINDOW}) AS c FROM o),
c AS (SELECT id_fnet, k, i, substr(c, 1, {classify.CLAUSE_SKIP}) || regexp_split_to_array(substr(c, {classify.CLAUSE_SKIP} + 1), '{classify.CLAUSE_END}')[1] AS c FROM r),
a AS (SELECT *, unnest(range(1, len(ps))) AS j FROM (SELECT *, string_split(c, '%') AS ps FROM c)),
percent AS (SELECT id_fnet, (k, i, 0, j) AS place, regexp_extract(ps[j], '{ENDED}', 1) AS value, CASE WHEN regexp_matches(substr(array_to_string(ps[j + 1:], '%'), 1, {classify.YEARLY_WINDOW}), '{classify.YEARLY}') THEN 'pct_aa' ELSE 'pct_sem_periodo' END AS kind FROM a),
b AS (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM (SELECT *, regexp_extract_all(c, '{classify.MONEY}') AS hits, regexp_extract_all(c, '{classify.MONEY}', 1) AS vs, regexp_split_to_array(c, '{classify.MONEY}') AS gaps FROM c)),
e AS (SELECT *, CAST(list_sum(list_transform(gaps[1:j], lambda g: len(g))) + list_sum(list_transform(hits[1:j], lambda g: len(g))) AS BIGINT) AS stop FROM b),
n AS (SELECT id_fnet, (k, i, 1, j) AS place, vs[j] AS value, substr(c, greatest(stop - len(hits[j]) - {classify.VALUE_CONTEXT}, 0) + 1, stop + {classify.VALUE_CONTEXT} - greatest(stop - len(hits[j]) - {classify.VALUE_CONTEXT}, 0)) AS around FROM e),
money AS (SELECT id_fnet, place, value, CASE WHEN NOT regexp_matches(around, '{classify.MONTHLY}') THEN 'outros_valores' WHEN regexp_matches(around, 'minim[oa]') THEN 'minimos_mensais' WHEN regexp_matches(around, '{classify.FIXED}') THEN 'fixos_mensais' ELSE 'outros_valores' END AS kind FROM n),
f AS (SELECT id_fnet, kind, value, min(place) AS place FROM (SELECT * FROM percent WHERE value <> '' UNION ALL SELECT * FROM money) GROUP BY ALL),
l AS (SELECT id_fnet, {LISTS} FROM f GROUP BY id_fnet),
s AS (SELECT id_fnet, bool_or(regexp_matches(c, '{classify.VARIABLE}')) AS v FROM c GROUP BY id_fnet)
SELECT id_fnet, v IS NOT NULL AS presente, coalesce(v, false) AS tem_variavel, {", ".join(f"coalesce({k}, CAST([] AS VARCHAR[])) AS {k}" for k in KINDS)} FROM t LEFT JOIN s USING (id_fnet) LEFT JOIN l USING (id_fnet)""")
def fee_extract(spark, d):
    """A clause of each kind before the text, ended by the next title; none before every eleventh."""
    i = F.col("id_fnet")
    pick = lambda n, *of: F.element_at(F.lit(list(of)), (i % n + 1).cast("int"))
    pct = F.concat((i % 7).cast("string"), F.lit(","), (10 + i % 90).cast("string"), F.lit("% "), pick(3, "ao ano", "(zero) a.a.", "sobre o patrimonio"))
    value = F.when(i % 4 < 3, F.concat(pick(4, ", minimo mensal", ", mensal fixo", ", unico", ""), F.lit(" de r$ "), (i % 50).cast("string"), F.lit(".500,00"))).otherwise("")
    clause = F.concat(F.lit("taxa de consultoria de "), pct, value, F.when(i % 5 == 0, " e remuneracao variavel").otherwise(""), F.lit("; despesas do fundo 9% r$ 1,00 "))
    rows = D.texts(spark, d).withColumn("texto_norm", F.concat(F.when(i % 11 != 0, clause).otherwise(""), "texto_norm"))
    return classify.fees(rows).select("id_fnet", "f.*")


ELIGIBLE = f"(SELECT min(id_fnet) AS id_fnet, cnpj FROM {D.DOCUMENTS} WHERE {{}} GROUP BY cnpj HAVING cnpj NOT IN (SELECT cnpj FROM {D.FUNDS} WHERE situacao = 'CANCELADA'))"


@query(f"SELECT cnpj, e.id_fnet, CAST(count(*) AS INTEGER) AS n_trechos FROM {ELIGIBLE.format('true')} e JOIN {cut(LICENSE, 3)} c ON e.id_fnet = c.id_fnet GROUP BY cnpj, e.id_fnet")
def prospecting(spark, d):
    docs = D.documents(spark, d).withColumns({"descricao": F.lit(None).cast("string"), "arrival": F.col("id_fnet")})
    return prospect.prospect(docs, D.texts(spark, d), D.funds(spark, d), ["license"], category=None).select("cnpj", "id_fnet", F.size("trechos").alias("n_trechos"))


@query(f"SELECT cnpj, id_fnet FROM (SELECT * FROM {ELIGIBLE.format("categoria IN ('en')")} ORDER BY id_fnet LIMIT 40) e WHERE id_fnet IN (SELECT id_fnet FROM {cut(THE, 1)}) ORDER BY id_fnet LIMIT 12")
def prospecting_stops(spark, d):
    """A category by a folded part of its name; so many documents are read and so many funds returned at most."""
    docs = D.documents(spark, d).withColumns({"descricao": F.lit(None).cast("string"), "arrival": F.col("id_fnet")})
    return prospect.prospect(docs, D.texts(spark, d), D.funds(spark, d), ["the"], category="N", most_documents=40, wanted=12).select("cnpj", "id_fnet")


@query(f"""WITH r AS (SELECT cnpj, id_fnet FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY data_entrega DESC NULLS LAST, id_fnet DESC) AS n FROM {D.DOCUMENTS} WHERE categoria = 'fr') WHERE n = 1),
f AS (SELECT cnpj, denominacao, situacao, lpad(CAST(CAST(cnpj AS BIGINT) % 100 AS VARCHAR), 14, '0') AS classe FROM {D.FUNDS})
SELECT f.cnpj, denominacao, situacao, coalesce(CAST(coalesce(a.id_fnet, b.id_fnet) AS VARCHAR), '') AS doc_id, CASE WHEN coalesce(a.id_fnet, b.id_fnet) IS NULL THEN 'nenhum regulamento no FNET' WHEN a.id_fnet IS NULL THEN 'regulamento sob o CNPJ da classe ' || classe ELSE '' END AS obs,
CASE WHEN coalesce(a.id_fnet, b.id_fnet) IS NULL THEN '' ELSE '{classify.DOCUMENT_URL}' || coalesce(a.id_fnet, b.id_fnet) END AS url_fnet, CASE WHEN coalesce(a.id_fnet, b.id_fnet) IS NULL THEN '' ELSE 'nao' END AS consultoria_presente,
CASE WHEN coalesce(a.id_fnet, b.id_fnet) IS NULL THEN '' ELSE 'indeterminado' END AS cedencia FROM f LEFT JOIN r a ON f.cnpj = a.cnpj LEFT JOIN r b ON f.classe = b.cnpj""")
def fee_survey(spark, d):
    """The newest regulation of a fund, else of its class."""
    own = F.lpad((F.col("cnpj").cast("bigint") % 100).cast("string"), 14, "0")
    funds = D.funds(spark, d).withColumns({"fonte": F.lit("registro"), "cnpjs_classes": F.array(own)})
    docs = D.documents(spark, d).withColumn("categoria", F.when(F.col("categoria") == "fr", "Regulamento do Fundo").otherwise(F.col("categoria")))
    texts = D.texts(spark, d).withColumn("num_paginas", F.lit(1))
    return classify.fee_survey(funds, docs, texts).select("cnpj", "denominacao", "situacao", "doc_id", "obs", "url_fnet", "consultoria_presente", "cedencia")


@query("SELECT count(*) AS fundos, count(*) FILTER (c_nationkey % 4 = 0) AS ocr, count(*) FILTER (c_nationkey % 4 = 1) AS sem_documento, count(*) FILTER (c_nationkey % 4 = 2) AS erros FROM customer")
def survey_summary(spark, d):
    obs = F.element_at(F.lit(["PDF sem camada de texto (precisa de OCR)", "nenhum regulamento no FNET", "ValueError: x", ""]), F.col("c_nationkey") % 4 + 1)
    return classify.survey_summary(D.read(spark, d, "customer").select(obs.alias("obs")))
