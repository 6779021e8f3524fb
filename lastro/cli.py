"""Commands over a folder of Parquet tables: python -m lastro.cli COMMAND --store FOLDER ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro import schema
from lastro.operators import classify, export, health, ingest, metrics, postings, prospect, quality, report, search, upsert
from lastro.sources import csvzip, documents, html, paged
from lastro.store import KEPT, Store  # noqa: F401  KEPT: what a store keeps
from lastro.streaming import sync


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def sync_registry(store: Store, args) -> dict:
    """The registry's rows, if its columns still hold what they are for: the check's counts are taken while the rows are read."""
    funds = ingest.registry_funds(csvzip.table(store.spark, args.file)).withColumn("atualizado_em", F.lit(_now()).cast("timestamp_ntz"))
    funds, seen = quality.observed(funds, quality.REGISTRY_FILLED, f"registry-{uuid.uuid4().hex}")
    store.merge("fundos", funds, ["cnpj"], check=quality.require(seen, dict.fromkeys(args.exigir or (), args.minimo), what=args.file))
    return seen.get


def _load_reports(store: Store, reports: DataFrame, attributes: DataFrame, kind: str) -> None:
    measures = ["versao", "pl", "num_cotistas", "valor_cota", "fonte"]
    full = reports.select("cnpj", "competencia", *[F.col(m) if m in reports.columns else F.lit(None).alias(m) for m in measures])
    store.merge("informes_mensais", full, ["cnpj", "competencia"])
    sync.merge_parents(store, full)
    store.merge("fundos", attributes, ["cnpj"], how=lambda funds, own: upsert.enrich(funds, own, "cnpj", {"tipo_veiculo": F.lit(kind)}))


def sync_fii(store: Store, args) -> None:
    """The monthly archives, one or a pattern of many: each member of each is a task's."""
    parts = [csvzip.table(store.spark, *args.file.split(","), token=t) for t in ("geral", "complemento", "ativo_passivo")]
    _load_reports(store, *ingest.fii_reports(*parts), "FII")


def sync_fidc(store: Store, args) -> None:
    _load_reports(store, *ingest.fidc_reports(csvzip.tables(store.spark, args.file), args.file), "FIDC")


def recompute(store: Store, args) -> None:
    out = metrics.fund_metrics(store.read("informes_mensais"))
    store.write("fundos_metricas", out.withColumn("atualizado_em", F.lit(_now()).cast("timestamp_ntz")))


def _paged(store: Store, args, tipos: str):
    """A reader of the paged source, of the service (--servico) or of stored answers (--file)."""
    paged.register(store.spark)
    where = ("url", args.servico) if args.servico else ("files", args.file)
    if where[1] is None:
        raise SystemExit("--servico or --file is needed")
    return {"tipos": tipos, where[0]: where[1], "size": str(args.pagina)}


def sync_documents(store: Store, args) -> dict:
    """Each fund type by its own cursor; a type that fails doesn't stop the others, and one that fills all pages is named.

    The cursor is in the request, so a type that has more pages than a run reads goes on where the last run ended.
    """

    def one(tipo: str) -> dict:
        source = sync.cursor_name(tipo, args.categoria)
        cursor = dt.datetime.fromisoformat(args.desde) + paged.OVERLAP if args.desde else sync.cursor_of(store.read("sync_state"), source, sync.cursor_name("all", args.categoria))
        raw = store.spark.read.format("documents").options(**_paged(store, args, tipo), maxPages=args.max_paginas).load()
        if cursor is not None:
            raw = raw.filter(F.col("entrega") >= F.lit(cursor - paged.OVERLAP).cast("timestamp_ntz"))
        if args.categoria and args.categoria.isdigit():
            raw = raw.filter(F.col("id_categoria") == int(args.categoria))
        folder = f"{store.folder}/pages-{uuid.uuid4().hex}"
        try:
            raw.write.parquet(folder)  # asked for once, whatever is read of the answers
            raw = store.spark.read.schema(raw.schema).parquet(folder)
            seen = (raw.agg(F.max("arrival").alias("m")).first().m or 0) + 1  # places in the request's order, so rows before the cursor count
            fresh = sync.fetched(raw)
            if args.categoria and not args.categoria.isdigit():
                fresh = fresh.filter(F.col("categoria") == args.categoria)
            sync.merge_documents(store, fresh)
            newest = sync.new_cursor(fresh, source, _now())
            store.merge("sync_state", newest, ["fonte"])
            cut = sync.truncated(seen, args.max_paginas, args.pagina)
            after = newest.first()
            stuck = cut and cursor is not None and (after is None or dt.datetime.fromisoformat(after.cursor).date() <= cursor.date())
            return {"documentos": fresh.count(), "truncado": cut, "parado": stuck}
        finally:
            store.remove(folder)

    done = sync.sync_types(args.tipos.split(","), one)
    cut = [t for t, r in done.items() if r["truncado"]]
    if cut:
        print(f"truncated after {args.max_paginas} pages: {', '.join(cut)}; the next run goes on from the cursor", file=sys.stderr)
    stuck = [t for t, r in done.items() if r["parado"]]
    if stuck:
        print(f"more than {args.max_paginas} pages lie within a day of the cursor: {', '.join(stuck)}; --max-paginas must be larger", file=sys.stderr)
    return {"documentos": sum(r["documentos"] for r in done.values()), "tipos_truncados": cut}


def follow(store: Store, args) -> dict:
    """The same as a stream: what each type has delivered since its cursor, until there is no more; progress is in the store's checkpoint."""
    types = args.tipos.split(",")
    cursors = sync.stored_cursors(store.read("sync_state"), types)
    raw = store.spark.readStream.format("documents").options(**_paged(store, args, args.tipos), cursors=json.dumps(cursors)).load()
    before = store.read("documentos").count()
    query = sync.stream_documents(sync.fetched(raw), store, f"{store.folder}/checkpoints/documentos", types=types)
    query.awaitTermination()
    return {"documentos_novos": store.read("documentos").count() - before}


def download(store: Store, args) -> dict:
    """Fetches pending documents, newest first, into the store's folder of files."""
    queue = sync.download_queue(store.read("documentos"), args.limite, tuple(args.categorias or ()))
    found = documents.download(queue, args.origem, f"{store.folder}/files", tasks=args.tarefas)
    folder = f"{store.folder}/downloads-{uuid.uuid4().hex}"
    found.write.parquet(folder)  # fetched once, whatever is read of the results
    found = store.spark.read.parquet(folder)
    store.merge("documentos", found, ["id_fnet"], how=sync.downloaded)
    totals = found.agg(F.count("url_storage").alias("baixados"), F.count_if(F.col("url_storage").isNull()).alias("erros")).first().asDict()
    store.remove(folder)
    return totals


def sync_domains(store: Store, args) -> None:
    pages = store.spark.read.text(args.file, wholetext=True).withColumnRenamed("value", "html")
    found = html.select_options(pages).dropDuplicates(["grupo", "id_fnet"])
    store.merge("dominios", found, ["grupo", "id_fnet"])


def extract(store: Store, args) -> None:
    queue = sync.extraction_queue(store.read("documentos"), store.read("documento_textos"), again=args.reprocessar)
    files = documents.read_payloads(store.spark, args.file)
    files = files.withColumn("id_fnet", F.regexp_extract("path", r"(\d+)\.\w+$", 1).try_cast("bigint")).join(queue.select("id_fnet"), "id_fnet", "left_semi")
    texts = documents.texts(files).withColumn("extraido_em", F.lit(_now()).cast("timestamp_ntz"))
    folder = f"{store.folder}/texts-{uuid.uuid4().hex}"
    texts.write.parquet(folder)  # extracted once, for the table and for the index
    texts = store.spark.read.schema(texts.schema).parquet(folder)
    # The index first: a run that ends between the two leaves candidates that no text confirms.
    postings.index_texts(store, texts)
    store.merge("documento_textos", texts, ["id_fnet"])
    store.remove(folder)


def find(store: Store, args) -> None:
    f = search.filters_from_query(args.filtros, export=bool(args.csv))
    found = postings.candidates(store, list(f.termos), f.exigir_todos_termos, not f.literal) if f.termos else None
    texts = store.read("documento_textos") if found is None else postings.texts_of(store, found)
    result = search.search(store.read("fundos"), store.read("fundos_metricas"), store.read("documentos"), texts, f)
    if args.csv:
        _spreadsheet(store, export.export_rows(result.funds, ("pl_medio_12m", "documento")), ("-ordem_pl_medio_12m", "cnpj", "ordem_documento"), args.csv, export.COLUMNS)
    elif args.json:
        print(f"{result.total} fundos")
        for row in export.json_rows(result.funds).toLocalIterator():  # a page
            print(row.value)
    else:
        print(f"{result.total} fundos")
        for row in search.by_size(report.fund_lines(result.funds)).select("value").toLocalIterator():  # a page
            print(row.value)


def _spreadsheet(store: Store, rows: DataFrame, order: tuple[str, ...], target: str, columns: tuple[str, ...] | None = None) -> None:
    """Rows in an order as one file, sorted and written by the executors and then joined."""
    folder = f"{store.folder}/export-{uuid.uuid4().hex}"
    try:
        export.write_ordered(rows, order, folder, columns)
        export.join_parts(store.spark, folder, target)
    finally:
        store.remove(folder)


def explore(store: Store, args) -> None:
    # Newest first by delivery, then by id.
    age = F.struct(F.coalesce(-F.unix_micros(F.col("data_entrega").cast("timestamp")), F.lit(0)), -F.col("id_fnet"))
    docs = store.read("documentos").withColumns({"descricao": F.col("denominacao_fundo"), "arrival": age})
    found = prospect.prospect(docs, store.read("documento_textos"), store.read("fundos"), args.termo, args.categoria, wanted=args.alvo)
    for row in export.json_rows(found).toLocalIterator():
        print(row.value)


def survey(store: Store, args) -> None:
    """Fees and assignors of an administrator's funds, in the order of the registry's file if there is one, else of their ids."""
    if args.registro:
        path = csvzip.first_readable(store.spark, *args.registro)
        registry = ingest.registry_class_archive(*(csvzip.table(store.spark, path, token=t) for t in ("registro_fundo", "registro_classe")), keep_order=True)
        legacy = store.read("fundos").select("cnpj", "denominacao", F.col("tipo_veiculo").alias("tipo"), "situacao", "administrador", "gestor", "publico_alvo")
        funds = ingest.universe(registry, legacy.withColumn("row_idx", F.lit(None).cast("long")))
        # Funds of the registry in its order, then those that it lacks by their ids.
        funds = funds.withColumn("row_idx", F.struct(F.col("row_idx").isNull(), "row_idx", "cnpj"))
    else:
        funds = store.read("fundos").withColumnRenamed("tipo_veiculo", "tipo").withColumns({"fonte": F.lit("cad_fi"), "row_idx": F.col("cnpj")})
    chosen = classify.select_funds(funds, args.administrador, args.tipo, most=args.max_fundos)
    rows = classify.fee_survey(chosen, store.read("documentos"), store.read("documento_textos"), keep=("row_idx",))
    _spreadsheet(store, rows, ("row_idx",), args.saida, tuple(c for c in rows.columns if c != "row_idx"))


def check(store: Store, args) -> int:
    """Whether files still have the layout that the loaders read, and how their columns are filled; nothing is stored."""
    wrong = 0
    for path in args.arquivos:
        try:
            funds = ingest.registry_funds(csvzip.table(store.spark, path))
            rates = csvzip.fill_rates(funds, list(quality.REGISTRY_FILLED)).first().asDict()
            empty = [c for c in quality.REGISTRY_FILLED if rates["rows"] and not rates[c]]
            said = f"columns without a value: {', '.join(empty)}" if empty else json.dumps({k: round(v, 3) if isinstance(v, float) else v for k, v in rates.items()})
        except Exception as exc:  # noqa: BLE001  the other files are looked at too
            empty, said = [path], f"{type(exc).__name__}: {exc}".splitlines()[0]
        wrong += bool(empty)
        print(f"{'FALHA' if empty else 'OK'} {path}: {said}")
    return int(wrong > 0)


def status(store: Store, args) -> int:
    tables = [store.read(n) for n in ("sync_runs", "fundos", "informes_mensais", "documentos", "documento_textos")]
    checks = health.diagnose(*tables, _now())
    if args.http:
        code, body = health.as_http(checks, health.counts(*tables[1:]))
        print(f"{code} {body}")
    elif args.texto:
        print("\n".join(report.check_lines(checks)))
    else:
        print(health.as_json(checks))
    return int(args.check and health.worst(checks).first().status == "erro")


COMMANDS = {
    "sync-registry": (sync_registry, ("file", "exigir", "minimo")), "sync-fii": (sync_fii, ("file",)), "sync-fidc": (sync_fidc, ("file",)), "metrics": (recompute, ()),
    "sync-documents": (sync_documents, ("file?", "servico", "tipos", "categoria_unica", "desde", "pagina", "max_paginas")), "follow-documents": (follow, ("file?", "servico", "tipos", "pagina")),
    "download-docs": (download, ("origem", "categorias", "limite", "tarefas")), "domains": (sync_domains, ("file",)), "extract": (extract, ("file", "reprocessar")),
    "search": (find, ("filtros", "csv", "json")), "prospect": (explore, ("termo", "categoria", "alvo")), "survey": (survey, ("administrador", "tipo", "max_fundos", "saida", "registro")),
    "status": (status, ("check", "http", "texto")), "check-files": (check, ("arquivos",)),
}
FLAGS = {
    "file": {"required": True}, "file?": {"default": None}, "servico": {"default": None}, "exigir": {"action": "append"}, "minimo": {"type": float, "default": 0.0}, "tipos": {"required": True},
    "categoria_unica": {"default": None, "dest": "categoria"}, "desde": {"default": None}, "pagina": {"type": int, "default": paged.PAGE}, "max_paginas": {"type": int, "default": paged.MOST_PAGES},
    "origem": {"required": True}, "categorias": {"action": "append"}, "limite": {"type": int, "default": None}, "tarefas": {"type": int, "default": 1}, "reprocessar": {"action": "store_true"}, "filtros": {"default": ""},
    "csv": {"default": None}, "json": {"action": "store_true"}, "termo": {"action": "append", "required": True}, "categoria": {"default": "Regulamento"}, "alvo": {"type": int, "default": None},
    "administrador": {"default": ""}, "tipo": {"default": "FIDC"}, "max_fundos": {"type": int, "default": None}, "saida": {"required": True}, "registro": {"action": "append"}, "check": {"action": "store_true"},
    "http": {"action": "store_true"}, "texto": {"action": "store_true"}, "arquivos": {"action": "append", "required": True},
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, flags) in COMMANDS.items():
        own = commands.add_parser(name)
        own.add_argument("--store", required=True)
        for flag in flags:
            own.add_argument(f"--{flag.rstrip('?').replace('_', '-')}", **FLAGS[flag])
    args = parser.parse_args(argv)
    store = Store(spark or SparkSession.builder.getOrCreate(), args.store)
    if args.command in ("search", "prospect", "survey", "status", "check-files"):
        return COMMANDS[args.command][0](store, args) or 0
    kind = schema.schema("sync_runs")
    number = (store.read("sync_runs").agg(F.max("id").alias("m")).first().m or 0) + 1

    def note(row: dict) -> None:
        """The run's row, written when it begins and again when it ends: one that is killed stays `executando`."""
        own = store.spark.createDataFrame([tuple((row | {"id": number})[f.name] for f in kind)], kind)
        store.merge("sync_runs", own, ["id"])

    with health.recorded([], args.command, note=note) as details:
        details |= COMMANDS[args.command][0](store, args) or {}
    return 0


if __name__ == "__main__":
    sys.exit(main())
