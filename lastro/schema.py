"""Tables of the fund store, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "fundos": "cnpj string, denominacao string, tipo_veiculo string, publico_alvo string, situacao string, administrador string, gestor string, segmento string, classe_cvm string, dt_registro date, atualizado_em timestamp_ntz",
    "informes_mensais": "cnpj string, competencia date, versao int, pl decimal(20,2), num_cotistas int, valor_cota decimal(20,8), fonte string",
    "fundos_metricas": "cnpj string, competencia_ultima date, pl_atual decimal(20,2), pl_medio_12m decimal(20,2), cotistas_atual int, atualizado_em timestamp_ntz",
    "documentos": "id_fnet bigint, cnpj string, denominacao_fundo string, categoria string, tipo string, especie string, data_referencia string, competencia date, data_entrega timestamp_ntz, situacao string, versao int, modalidade string, status_download string, url_storage string, formato string, baixado_em timestamp_ntz, raw_json string",
    "documento_textos": "id_fnet bigint, texto string, texto_norm string, num_paginas int, num_caracteres int, origem string, extraido_em timestamp_ntz",
    "documento_tokens": "token string, id_fnet bigint",
    "dominios": "grupo string, id_fnet string, rotulo string",
    "sync_state": "fonte string, cursor string, atualizado_em timestamp_ntz",
    "sync_runs": "id bigint, fonte string, iniciado_em timestamp_ntz, terminado_em timestamp_ntz, status string, detalhe string, erro string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


#: What part of its table a row lies in, from its key: rows that arrive together lie together.
PARTS = {
    "fundos": "pmod(xxhash64(cnpj), 16)", "fundos_metricas": "pmod(xxhash64(cnpj), 16)", "informes_mensais": "date_format(competencia, 'yyyyMM')", "documentos": "id_fnet div 10000",
    "documento_textos": "id_fnet div 10000",
    "documento_tokens": "concat(id_fnet div 10000, '-', pmod(xxhash64(token), 16))", "dominios": "0", "sync_state": "0", "sync_runs": "id div 1000",
}


def part(table: str) -> Column:
    """The part's name; rows without the key share one."""
    return F.coalesce(F.expr(PARTS[table]).cast("string"), F.lit("nulo"))
