"""Tolerant parsing of regulator values, as Column expressions.

All of them are null for null, and null rather than an error for what can't be read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the sources' own tools understand it, as a class and as characters.
SPACES = r"[\s\x1c-\x1f\x85]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A fund's registration number inside other text (fixed value).
CNPJ_PATTERN = r"(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)"


class LayoutError(ValueError):
    """A file lacks a required column."""


def column_name(name: str) -> str:
    """Upper-case ASCII with `_` for runs of anything else."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^0-9A-Za-z]+", "_", plain).strip("_").upper()


def resolve(columns: Iterable[str], wanted: dict[str, tuple[str, ...]], required: Iterable[str] = (), filename: str = "") -> dict[str, str | None]:
    """For each wanted name the column that has the first candidate present; of equal normalised names the last column."""
    by_name = {column_name(c): c for c in columns}
    found = {k: next((by_name[c] for c in candidates if c in by_name), None) for k, candidates in wanted.items()}
    for k in required:
        if found[k] is None:
            raise LayoutError(f"{filename}: none of {', '.join(wanted[k])} among {', '.join(sorted(by_name))}")
    return found


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def cell(c: Column) -> Column:
    """Without white space around it; empty is null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"(?U){SPACES}+", " "))


def cnpj(c: Column) -> Column:
    """Digits alone, with zeros in front up to 14; longer ones stay as they are."""
    digits = F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(14)), F.lit("0"))


def cnpj_valid(c: Column) -> Column:
    """14 digits, not all equal, with both check digits."""
    digits = F.regexp_replace(c, r"[^0-9]", "")

    each = F.transform(F.split(digits, ""), lambda x: x.try_cast("int"))

    def check(n: int) -> Column:
        weights = F.lit([(n - 1 - i) % 8 + 2 for i in range(n)])
        total = F.aggregate(F.zip_with(F.slice(each, 1, n), weights, lambda x, w: x * w), F.lit(0), lambda a, b: a + b)
        return (11 - total % 11) % 11 % 10  # what would be 10 or 11 is 0

    fine = (F.length(digits) == 14) & (digits != F.repeat(F.substring(digits, 1, 1), F.lit(14))) & (F.get(each, F.lit(12)) == check(12)) & (F.get(each, F.lit(13)) == check(13))
    return F.coalesce(fine, F.lit(False))


def number_text(c: Column) -> Column:
    """A number's text with `.` as the decimal sign: with `,` and `.` the points group digits."""
    return F.when(F.contains(c, F.lit(",")), F.translate(strip(c), ",.", ".")).otherwise(strip(c))


def decimal(c: Column, scale: int = 2) -> Column:
    return number_text(c).try_cast(f"decimal(20,{scale})")


def integer(c: Column) -> Column:
    """The number truncated toward zero."""
    wide = number_text(c).try_cast("decimal(38,10)")
    return F.when(wide >= 0, F.floor(wide)).otherwise(F.ceil(wide)).try_cast("int")


def month(c: Column) -> Column:
    """First of the month of `YYYY-MM...` or `MM/YYYY`; one pattern looks at the value once, white space around it included."""
    found = F.regexp_extract(c, f"(?U)^{SPACES}*([0-9]{{4}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{4}}(?={SPACES}*$))", 1)
    return F.try_to_date(F.concat(F.regexp_replace(found, "^(..)/(....)$", "$2-$1"), F.lit("-01")), "yyyy-MM-dd")


def reference_month(c: Column) -> Column:
    """First of the month of `DD/MM/YYYY...`, else as month()."""
    x = strip(c)
    day = F.when(x.rlike(r"^\d{2}/\d{2}/\d{4}"), F.substring(x, 4, 7))
    return month(F.coalesce(day, c))


def date(c: Column) -> Column:
    x = strip(c)
    return F.coalesce(F.try_to_date(x, "yyyy-M-d"), F.try_to_date(x, "d/M/yyyy"))


def delivered(c: Column) -> Column:
    """`d/m/Y` with hours and minutes, with seconds too, or alone."""
    x = strip(c)
    tries = [F.try_to_timestamp(x, F.lit(f)).cast("timestamp_ntz") for f in ("d/M/yyyy H:m", "d/M/yyyy H:m:s", "d/M/yyyy")]
    return F.coalesce(*tries)


def vehicle_type(kind: Column, name: Column) -> Column:
    """The registry's fund type in the vocabulary of the filters."""
    tp, nm = F.upper(strip(F.coalesce(kind, F.lit("")))), F.upper(F.coalesce(name, F.lit("")))
    return (
        F.when(F.contains(tp, F.lit("FIAGRO")) | F.contains(nm, F.lit("FIAGRO")), "FIAGRO")
        .when(F.contains(tp, F.lit("FIDC")), "FIDC")
        .when(F.startswith(tp, F.lit("FII")), "FII")
        .when(F.startswith(tp, F.lit("FIP")) | (tp == "FMIEE"), "FIP")
        .when(tp.isin("FI", "FIF", "FICFI", "FIC"), "FIF")
        .otherwise(F.nullif(tp, F.lit("")))
    )


def months_between(first: Column, last: Column) -> Column:
    """`YYYYMM` of each month from first to last."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyyMM"))


def detect_format(content: Column) -> Column:
    """pdf, zip, xml, json, html or bin by the first bytes after ASCII white space."""
    head = F.regexp_replace(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), r"^[ \t\n\r\x0b\x0c]+", "")
    return (
        F.when(F.startswith(head, F.lit("%PDF")), "pdf")
        .when(F.startswith(head, F.lit("PK\x03\x04")), "zip")
        .when(F.startswith(head, F.lit("<?xml")), "xml")
        .when(F.startswith(head, F.lit("{")), "json")
        .when(F.startswith(head, F.lit("<")), "html")
        .otherwise("bin")
    )


def maybe_base64(content: Column) -> Column:
    """Decoded content if it is of unknown format, is strict base64, and decodes to a known format."""
    text = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[ \t\n\r\x0b\x0c]+", "")
    strict = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (text != "")
    plain = F.when(strict, F.unbase64(text))
    use = (detect_format(content) == "bin") & F.coalesce(detect_format(plain) != "bin", F.lit(False))
    return F.when(use, plain).otherwise(content)


def cnpj_in(c: Column) -> Column:
    """The first registration number inside a text."""
    return cnpj(F.regexp_extract(c, CNPJ_PATTERN, 0))


def cnpj_mask(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def millions(c: Column) -> Column:
    """A compact amount, `R$ 1.234,5mi`; null and zero have none."""
    value = c.cast("decimal(38,10)")
    text = F.translate(F.format_number(F.bround(value / F.lit(1_000_000).cast("decimal(10,0)"), 1), 1), ",.", ".,")
    return F.when(value != 0, F.concat(F.lit("R$ "), text, F.lit("mi")))
