"""Incremental sync: cursors with overlap, work queues, and the same as a stream."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lastro.operators.health import ERROR_CHARS
from lastro.operators.upsert import upsert
from lastro.sources.documents import document_rows
from lastro.sources.paged import OVERLAP
from lastro.store import Store

DOWNLOAD_STATE = ("status_download", "url_storage", "formato", "baixado_em")


def cursor_of(state: DataFrame, source: str, legacy: str | None = None) -> dt.datetime | None:
    """The source's own cursor, else the legacy one's."""
    rows = {r.fonte: r.cursor for r in state.filter(F.col("fonte").isin(*[s for s in (source, legacy) if s])).collect()}  # two rows at most
    found = rows.get(source) or (rows.get(legacy) if legacy else None)
    return dt.datetime.fromisoformat(found) if found else None


def since(documents: DataFrame, cursor: dt.datetime | None, at: str = "data_entrega") -> DataFrame:
    """What a sync reads: everything from the cursor less the overlap."""
    return documents if cursor is None else documents.filter(F.col(at) >= F.lit(cursor - OVERLAP).cast("timestamp_ntz"))


def last_arrivals(rows: DataFrame, key: str = "id_fnet", order: str = "arrival") -> DataFrame:
    """Of rows with one id, the one that arrived last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def document_changes(arrivals: DataFrame) -> DataFrame:
    """One row per document that arrived, pendente."""
    return last_arrivals(arrivals).withColumn("status_download", F.lit("pendente"))


def upsert_documents(target: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata replaced, download state kept; new: document_changes()."""
    metadata = [c for c in new.columns if c in target.columns and c not in ("id_fnet", *DOWNLOAD_STATE)]
    return upsert(target, new.select(*[c for c in new.columns if c in target.columns]), ["id_fnet"], metadata)


def apply_documents(target: DataFrame, arrivals: DataFrame) -> DataFrame:
    """documentos after a sync: metadata replaced, download state kept; new rows are pendente."""
    return upsert_documents(target, document_changes(arrivals))


def merge_documents(store: Store, arrivals: DataFrame, notes: dict | None = None) -> list[str]:
    """The sync of arrivals (id_fnet, arrival and metadata) into the store: missing funds first, then the parts of documentos that they touch."""
    merge_parents(store, arrivals)
    return store.merge("documentos", document_changes(arrivals), ["id_fnet"], how=upsert_documents, notes=notes)


def merge_parents(store: Store, children: DataFrame) -> list[str]:
    """A bare fund for each cnpj of the children that the store doesn't have."""
    missing = children.select("cnpj").filter("cnpj is not null").distinct().join(store.read("fundos").select("cnpj"), "cnpj", "left_anti")
    return store.merge("fundos", missing, ["cnpj"])


def new_cursor(arrivals: DataFrame, source: str, now: dt.datetime) -> DataFrame:
    """The sync_state row of a source; none if nothing arrived."""
    latest = arrivals.agg(F.max("data_entrega").alias("m")).filter("m is not null")
    return latest.select(F.lit(source).alias("fonte"), F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss").alias("cursor"), F.lit(now).cast("timestamp_ntz").alias("atualizado_em"))


def sync_types(types: list[str], one: Callable[[str], dict]) -> dict[str, dict]:
    """Syncs each type; a failure doesn't stop the others and is raised at the end."""
    done, failed = {}, {}
    for t in types:
        try:
            done[t] = one(t)
        except Exception as exc:  # noqa: BLE001  collected and raised below
            failed[t] = exc
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(types)} types failed: {', '.join(failed)}", list(failed.values()))
    return done


def truncated(rows: int, most_pages: int, size: int) -> bool:
    """Whether a request's pages may have been cut; the next one asks from the cursor on."""
    return rows >= most_pages * size


def download_queue(documents: DataFrame, most: int | None = None, categories: tuple[str, ...] = ()) -> DataFrame:
    out = documents.filter("status_download = 'pendente'")
    if categories:
        out = out.filter(F.col("categoria").isin(*categories))
    out = out.orderBy(F.col("data_entrega").desc_nulls_last(), F.col("id_fnet").desc())
    return out if most is None else out.limit(most)


def downloaded(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documentos after downloads. results: id_fnet, url_storage, formato, baixado_em; a null url is an error."""
    r = results.withColumn("status_download", F.when(F.col("url_storage").isNull(), "erro").otherwise("baixado"))
    return upsert(documents, r, ["id_fnet"], list(DOWNLOAD_STATE))


def extraction_queue(documents: DataFrame, texts: DataFrame, again: bool = False, ocr: bool = False) -> DataFrame:
    """Downloaded documents to extract: without text yet; or all; or those whose text came out empty."""
    ready = documents.filter("status_download = 'baixado'")
    if ocr:
        return ready.join(texts.filter("origem = 'vazio'").select("id_fnet"), "id_fnet", "left_semi")
    return ready if again else ready.join(texts.select("id_fnet"), "id_fnet", "left_anti")


def fetched(raw: DataFrame) -> DataFrame:
    """Rows of documentos (with arrival, and tipo_fundo, the type that was asked for) from those of the paged source."""
    rows = document_rows(raw.select(F.col("tipo").alias("tipo_fundo"), "tipo", "arrival", "value"))
    return rows.withColumn("tipo", F.coalesce("tipo_documento", "tipo")).drop("tipo_documento")


def cursor_name(tipo: str, category: str | None = None) -> str:
    return f"fnet_documentos:tf={tipo}:cat={category or 'all'}"


def stored_cursors(state: DataFrame, types: list[str], category: str | None = None) -> dict[str, str]:
    """The cursors of types and, as `all`, the one of older stores."""
    names = {cursor_name(t, category): t for t in [*types, "all"]}
    return {names[r.fonte]: r.cursor for r in state.filter(F.col("fonte").isin(*names)).collect()}  # a row per type


def stream_documents(source: DataFrame, store: Store, checkpoint: str, name: str = "documentos", types: list[str] | None = None, available: bool = True) -> StreamingQuery:
    """A stream of document rows (with arrival) into the store.

    Each batch upserts the parts that it touches. Its number is noted in the manifest that commits
    it, so a batch that comes again after a failure changes nothing. types: the source's types,
    whose cursors go to sync_state with each batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.folder)
        batch = batch.persist()
        try:
            if own.manifest("documentos")["notes"].get(f"batch:{name}", -1) < number:
                merge_documents(own, batch, {f"batch:{name}": number})
            if types is not None:
                now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
                latest = batch.groupBy("tipo_fundo").agg(F.max("data_entrega").alias("m")).filter("m is not null")
                state = latest.select(F.concat(F.lit("fnet_documentos:tf="), "tipo_fundo", F.lit(":cat=all")).alias("fonte"), F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss").alias("cursor"), F.lit(now).cast("timestamp_ntz").alias("atualizado_em"))
                own.merge("sync_state", state, ["fonte"])
        finally:
            batch.unpersist()

    writer = source.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


class RunLog(StreamingQueryListener):
    """Rows of sync_runs for streamed syncs: one when a query starts, closed when it ends, with the rows that it read."""

    def __init__(self, store: Store, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)):
        self.store, self.clock = store, clock
        self.open: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's name
        last = self.store.read("sync_runs").agg(F.max("id").alias("m")).first().m or 0
        row = {"id": max([last, *[r["id"] for r in self.open.values()]]) + 1, "fonte": event.name or str(event.id), "iniciado_em": self.clock(), "terminado_em": None, "status": "executando", "detalhe": None, "erro": None}
        self.open[str(event.runId)] = row | {"lidos": 0, "lotes": 0}
        self._note(row)

    def onQueryProgress(self, event) -> None:  # noqa: N802  Spark's name
        row = self.open.get(str(event.progress.runId))
        if row and event.progress.numInputRows:
            row["lidos"] += event.progress.numInputRows
            row["lotes"] += 1

    def onQueryTerminated(self, event) -> None:  # noqa: N802  Spark's name
        row = self.open.pop(str(event.runId), None)
        if row:
            detail = json.dumps({"lidos": row.pop("lidos"), "lotes": row.pop("lotes")})
            failed = event.exception
            self._note(row | {"terminado_em": self.clock(), "status": "erro" if failed else "ok", "detalhe": None if failed else detail, "erro": failed[:ERROR_CHARS] if failed else None})

    def _note(self, row: dict) -> None:
        from lastro import schema

        kind = schema.schema("sync_runs")
        self.store.merge("sync_runs", self.store.spark.createDataFrame([tuple(row[f.name] for f in kind)], kind), ["id"])
