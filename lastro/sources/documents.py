"""The document service's records and files: metadata rows, payload formats, downloads, text extraction."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path
from urllib.request import urlopen

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions import parsing as P
from lastro.functions.text import fold_text
from lastro.session import importable
from lastro.sources.paged import INTERVAL, fetch_with_retry

#: A text shorter than this counts as none (fixed value).
LEAST_CHARS = 200

RECORD = "id string, descricaoFundo string, cnpjFundo string, categoriaDocumento string, tipoDocumento string, especieDocumento string, dataReferencia string, dataEntrega string, situacaoDocumento string, versao string, modalidade string"


def document_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """Records' JSON as rows of documentos (metadata columns). Records without an id are dropped; what can't be read is null."""
    d = raw.withColumn("d", F.from_json(value, RECORD))
    text = lambda n: P.cell(F.col(f"d.{n}"))
    cnpj = F.coalesce(P.cnpj(text("cnpjFundo")), P.cnpj_in(text("descricaoFundo")))
    out = d.select(
        *[c for c in raw.columns if c != value],
        text("id").try_cast("bigint").alias("id_fnet"), cnpj.alias("cnpj"), text("descricaoFundo").alias("denominacao_fundo"),
        text("categoriaDocumento").alias("categoria"), text("tipoDocumento").alias("tipo_documento"), text("especieDocumento").alias("especie"),
        text("dataReferencia").alias("data_referencia"), P.reference_month(F.col("d.dataReferencia")).alias("competencia"), P.delivered(F.col("d.dataEntrega")).alias("data_entrega"),
        text("situacaoDocumento").alias("situacao"), text("versao").try_cast("int").alias("versao"), text("modalidade").alias("modalidade"), F.col(value).alias("raw_json"),
    )
    return out.filter("id_fnet is not null")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents: path, content (decoded if it was base64), formato."""
    files = spark.read.format("binaryFile").load(folder).select("path", P.maybe_base64(F.col("content")).alias("content"))
    return files.withColumn("formato", P.detect_format(F.col("content")))


def read_url(url: str) -> bytes:
    """The bytes behind a URL, or of a file of a shared folder."""
    if "://" not in url:
        url = Path(url).resolve().as_uri()
    with urlopen(url, timeout=60) as answer:  # noqa: S310  the caller names the source
        return answer.read()


def slotted(fetch: Callable[[str], bytes], task: int, tasks: int, interval: float, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[str], bytes]:
    """fetch, called in this task's own slots alone: of every `tasks` slots of `interval` seconds one is a task's.

    Tasks that begin to count at one moment together thus make one call in `interval` seconds.
    """
    begin, used = clock(), [-1]

    def run(url: str) -> bytes:
        round_ = max(used[0] + 1, int(-(-((clock() - begin) / interval - task) // tasks)) if interval else 0)
        used[0] = round_
        left = begin + (round_ * tasks + task) * interval - clock()
        if left > 0:
            wait(left)
        return fetch(url)

    return run


def download(queue: DataFrame, source: str, folder: str, fetch: Callable[[str], bytes] = read_url, interval: float = INTERVAL, tasks: int = 1) -> DataFrame:
    """Fetches a queue's documents into folder: id_fnet, url_storage, formato, baixado_em, one row each; a null url is an error.

    source: the address with {} for the id. The service allows about a request a second, all
    tasks together: they run as one barrier stage, meet before the first request, and from then
    on each keeps to its slots. tasks must not be more than the cluster runs at once. Files are
    named by id and format, so a stage that is run again writes the same ones.
    """
    importable(queue.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        context.barrier()  # a common zero, whatever the machines' clocks say
        get = slotted(fetch, context.partitionId(), tasks, interval)
        files, root = fs.FileSystem.from_uri(folder if "://" in folder else Path(folder).resolve().as_uri())
        for pdf in batches:
            out = []
            for i in pdf.id_fnet.tolist():
                try:
                    content = fetch_with_retry(partial(get, source.format(i)))
                    key = storage_key(i, format_of(content))
                    files.create_dir(f"{root}/{key.rpartition('/')[0]}", recursive=True)
                    with files.open_output_stream(f"{root}/{key}") as stream:
                        stream.write(content)
                    out.append((i, key, key.rpartition(".")[2], pd.Timestamp.now("UTC").tz_localize(None)))
                except Exception:  # noqa: BLE001  the row says that it failed, and the queue doesn't take it again
                    out.append((i, None, None, pd.NaT))
            yield pd.DataFrame(out, columns=["id_fnet", "url_storage", "formato", "baixado_em"])

    return queue.select("id_fnet").repartition(tasks).mapInPandas(run, "id_fnet long, url_storage string, formato string, baixado_em timestamp_ntz", barrier=True)


#: How the first bytes after white space tell a format, in this order (fixed values).
FORMATS = ((b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"<?xml", "xml"), (b"{", "json"), (b"<", "html"))


def format_of(content: bytes) -> str:
    head = content[:256].lstrip()
    return next((kind for start, kind in FORMATS if head.startswith(start)), "bin")


def storage_key(id_fnet: int, ext: str) -> str:
    return f"fnet/{id_fnet}.{ext}"


def extract_text(content: bytes, kind: str) -> tuple[str, str, int | None]:
    """Text, origin (pdf, xml or vazio) and pages of a payload. Tags of markup are kept. PDF needs an optional library."""
    import unicodedata

    text, origin, count = "", "xml", None
    if kind == "pdf":
        origin = "pdf"
        try:
            import io

            import pypdf

            reader = pypdf.PdfReader(io.BytesIO(content))
            text, count = "\n".join(p.extract_text() or "" for p in reader.pages), len(reader.pages)
        except ImportError:
            text = ""
    elif kind in ("xml", "html", "json"):
        text = content.decode("utf-8", "replace")
    text = unicodedata.normalize("NFC", text.replace("\x00", ""))
    return (text, origin, count) if len(text.strip()) >= LEAST_CHARS or kind != "pdf" and text else ("", "vazio", count)


def texts(payloads: DataFrame, key: str = "id_fnet") -> DataFrame:
    """Rows of documento_textos for payloads (key, content, formato)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract_text(bytes(c), f) for c, f in zip(pdf.content, pdf.formato, strict=True)]
            yield pd.DataFrame({"id_fnet": pdf[key], "texto": [t for t, _, _ in got], "texto_norm": [fold_text(t) for t, _, _ in got], "num_paginas": pd.array([n for _, _, n in got], "Int32"), "num_caracteres": [len(t) for t, _, _ in got], "origem": [o for _, o, _ in got]})

    importable(payloads.sparkSession)
    return payloads.select(key, "content", "formato").mapInPandas(run, "id_fnet long, texto string, texto_norm string, num_paginas int, num_caracteres int, origem string")
