"""Search results and checks as lines for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions import parsing as P

# The wording below is what readers of the reports go by.

RULE = "=" * 78
MARKS = {"ok": "ok", "aviso": "!", "erro": "X"}


def _or(c: str, text: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(text))


def fund_lines(found: DataFrame) -> DataFrame:
    """cnpj, pl_medio_12m and value, a fund's lines: its head, its documents and their snippets."""
    if "documentos" not in found.columns:
        found = found.withColumn("documentos", F.lit(None).cast("array<struct<id_fnet:bigint,categoria:string,competencia:date,trechos:array<struct<texto:string,possivel_vedacao:boolean>>>>"))

    def snippet(t: Column) -> Column:
        return F.concat(F.lit("     ..."), t["texto"], F.lit("..."), F.when(t["possivel_vedacao"], " [POSSÍVEL VEDAÇÃO]").otherwise(""))

    def document(d: Column) -> Column:
        head = F.concat(F.lit("  -- "), F.coalesce(d["categoria"], F.lit("")), F.lit(" ("), F.coalesce(d["competencia"].cast("string"), F.lit("s/ data")), F.lit(") doc "), d["id_fnet"].cast("string"))
        return F.array_join(F.concat(F.array(head), F.transform(d["trechos"], snippet)), "\n")

    pl = F.coalesce(P.millions(F.col("pl_medio_12m")), F.lit("PL n/d"))
    holders = F.coalesce(F.concat(F.col("cotistas_atual").cast("string"), F.lit(" cotistas")), F.lit("cotistas n/d"))
    head = F.concat(
        F.lit(f"\n{RULE}\n"), _or("denominacao", "(sem denominação)"), F.lit("  ["), F.col("cnpj"), F.lit("]\n  "), _or("tipo_veiculo", "?"), F.lit(" | "), _or("publico_alvo", "público-alvo n/d"),
        F.lit("\n  PL médio 12m: "), pl, F.lit(" | "), holders, F.lit(" | admin: "), _or("administrador", "n/d"),
    )
    body = F.array_join(F.transform(F.coalesce("documentos", F.array().cast(found.schema["documentos"].dataType)), document), "\n")
    return found.select("cnpj", "pl_medio_12m", F.concat(head, F.when(body != "", F.concat(F.lit("\n"), body)).otherwise("")).alias("value"))


def check_lines(checks: DataFrame) -> list[str]:
    """The worst status and a line for each check."""
    rows = checks.collect()  # a few checks
    worst = max((r.status for r in rows), key=["ok", "aviso", "erro"].index, default="ok")
    return [f"status geral: {worst.upper()}", "", "verificações:", *[f"  [{MARKS[r.status]}] {r.nome}: {r.mensagem}" for r in rows]]
