import base64
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lastro.functions import parsing as P


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("f", "value", "want"), [
    (P.cnpj, "11.222.333/0001-81", "11222333000181"), (P.cnpj, "123", "00000000000123"), (P.cnpj, "", None), (P.cnpj, None, None), (P.cnpj, "1" * 15, "1" * 15),
    (P.cnpj_valid, "11.222.333/0001-81", True), (P.cnpj_valid, "11222333000182", False), (P.cnpj_valid, "0" * 14, False), (P.cnpj_valid, None, False),
    (P.decimal, "1.234,56", Decimal("1234.56")), (P.decimal, "1234.5", Decimal("1234.50")), (P.decimal, "12,3", Decimal("12.30")), (P.decimal, "x", None), (P.decimal, " ", None),
    (P.integer, "1.234,9", 1234), (P.integer, "-1,9", -1), (P.integer, "abc", None),
    (P.month, "2024-05-17", dt.date(2024, 5, 1)), (P.month, "05/2024", dt.date(2024, 5, 1)), (P.month, "2024-13", None), (P.month, "17/05/2024", None),
    (P.reference_month, "29/07/2026 13:00", dt.date(2026, 7, 1)), (P.reference_month, "07/2026", dt.date(2026, 7, 1)),
    (P.date, "2015-3-1", dt.date(2015, 3, 1)), (P.date, "1/3/2015", dt.date(2015, 3, 1)), (P.date, "31/02/2015", None),
    (P.delivered, "29/07/2026 13:05", dt.datetime(2026, 7, 29, 13, 5)), (P.delivered, "29/07/2026 13:05:09", dt.datetime(2026, 7, 29, 13, 5, 9)), (P.delivered, "29/07/2026", dt.datetime(2026, 7, 29)),
    (P.cell, "  x\t", "x"), (P.cell, "\t ", None), (P.cnpj_in, "Fundo 11.222.333/0001-81 SA", "11222333000181"), (P.cnpj_in, "9911222333000181", None),
])
def test_values(spark, f, value, want):
    assert one(spark, f, value) == want


def test_columns():
    assert P.column_name(" Público-Alvo ") == "PUBLICO_ALVO"
    wanted = {"a": ("X", "Y"), "b": ("Z",)}
    assert P.resolve(["y", "Y ", "x"], wanted) == {"a": "x", "b": None}
    assert P.resolve(["y", "Y "], wanted)["a"] == "Y "
    with pytest.raises(P.LayoutError, match="Z"):
        P.resolve(["x"], wanted, ("b",), "f.csv")


@pytest.mark.parametrize(("kind", "name", "want"), [("fi", "x Fiagro", "FIAGRO"), ("FIDC-NP", "", "FIDC"), ("FII", "", "FII"), ("FMIEE", "", "FIP"), ("FICFI", "", "FIF"), ("outro", "", "OUTRO"), (None, None, None)])
def test_vehicle(spark, kind, name, want):
    assert spark.createDataFrame([(kind, name)], "k string, n string").select(P.vehicle_type(F.col("k"), F.col("n")).alias("x")).first().x == want


@pytest.mark.parametrize(("data", "want"), [(b"%PDF-1", "pdf"), (b"PK\x03\x04", "zip"), (b" <?xml", "xml"), (b'{"a"', "json"), (b"<html", "html"), (b"\x00", "bin"), (b"", "bin")])
def test_format(spark, data, want):
    assert one(spark, P.detect_format, bytearray(data), "binary") == want


def test_base64(spark):
    coded = base64.b64encode(b"%PDF-1.4 x")
    assert one(spark, P.maybe_base64, bytearray(coded[:4] + b"\n" + coded[4:]), "binary") == b"%PDF-1.4 x"
    assert one(spark, P.maybe_base64, bytearray(base64.b64encode(b"hello")), "binary") == base64.b64encode(b"hello")
    assert one(spark, P.maybe_base64, bytearray(b"<a>"), "binary") == b"<a>"


def test_white_space(spark):
    """Every character that the class of white space has is taken away, and no other; a month may stand between them."""
    rows = spark.createDataFrame([(chr(k),) for k in range(1, 0x3100)], "x string")
    x = F.concat("x", F.lit("a"), "x", F.lit("b"), "x")
    plain = F.regexp_replace(x, f"(?U)^{P.SPACES}+|{P.SPACES}+$", "")
    assert rows.filter(~P.strip(x).eqNullSafe(plain)).count() == 0
    assert rows.filter(P.strip(x) != x).count() == len(P.BLANKS)
    blank = rows.filter(F.lit(P.BLANKS).contains(F.col("x")))
    assert {r.m for r in blank.select(P.month(F.concat("x", F.lit("05/2024"), "x")).alias("m")).collect()} == {dt.date(2024, 5, 1)}


@pytest.mark.parametrize(("f", "value", "want"), [
    (P.month, " 2024-05-99", dt.date(2024, 5, 1)), (P.month, "05/2024 x", None), (P.month, "05/20245", None), (P.month, "x2024-05", None), (P.month, "", None), (P.month, None, None),
    (P.reference_month, "29/13/2026", None), (P.reference_month, " 29/07/2026", dt.date(2026, 7, 1)), (P.reference_month, "2026-07-29", dt.date(2026, 7, 1)), (P.reference_month, None, None),
    (P.decimal, " 1.234.567,89 ", Decimal("1234567.89")), (P.decimal, "1.234.567", None), (P.decimal, "1,2,3", None), (P.decimal, None, None), (P.cnpj, "x", None),
])
def test_odd_values(spark, f, value, want):
    assert one(spark, f, value) == want


def test_patterns_run_once(spark):
    """A key's plan holds each pattern a few times, not once for every way to read it."""
    rows = spark.createDataFrame([("1", "2024-05")], "a string, b string").select(P.cell(F.col("a")).alias("a"), P.cell(F.col("b")).alias("b"))
    kept = rows.select(P.cnpj(F.col("a")).alias("a"), P.month(F.col("b")).alias("b")).filter("a is not null and b is not null")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(w) for w in ("regexp_replace(", "regexp_extract(", "RLIKE(")) <= 12
