"""Options of HTML forms as rows, by patterns in the plan."""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lastro.functions.parsing import strip
from lastro.session import importable

SELECT = r"(?is)<select\b([^>]*)>(.*?)(?:</select\s*>|$)"
#: An option that ends before another begins.
OPTION = r"(?is)<option\b([^>]*)>((?:(?!<option\b).)*?)</option\s*>"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag's text, quoted or not; null if it isn't there."""
    pattern = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    parts = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.when(tag.rlike(pattern), F.concat(*parts))


@F.pandas_udf(StringType())
def unescaped(column: pd.Series) -> pd.Series:
    return column.map(entities.unescape, na_action="ignore")


def select_options(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """keep columns, grupo, id_fnet, rotulo: one row per labelled option inside each named select of each page."""
    importable(pages.sparkSession)
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    forms = pages.filter(F.contains(F.lower(html), F.lit("<select"))).withColumn("page", plain)
    each = F.arrays_zip(F.regexp_extract_all("page", F.lit(SELECT), 1).alias("tag"), F.regexp_extract_all("page", F.lit(SELECT), 2).alias("body"))
    forms = forms.select(*keep, F.posexplode(each).alias("form", "s"))
    forms = forms.select(*keep, "form", F.coalesce(F.nullif(attribute(F.col("s.tag"), "id"), F.lit("")), attribute(F.col("s.tag"), "name")).alias("grupo"), F.col("s.body").alias("body"))
    each = F.arrays_zip(F.regexp_extract_all("body", F.lit(OPTION), 1).alias("tag"), F.regexp_extract_all("body", F.lit(OPTION), 2).alias("label"))
    rows = forms.filter("grupo <> ''").select(*keep, "form", "grupo", F.posexplode(each).alias("place", "o"))
    label = F.regexp_replace("o.label", r"(?s)<[^>]*>", "")
    rows = rows.select(*keep, "grupo", F.coalesce(attribute(F.col("o.tag"), "value"), F.lit("")).alias("id_fnet"), label.alias("rotulo"))
    # Entities are the one thing that Spark can't read; forms are few.
    rows = rows.select(*keep, *[unescaped(F.col(c)).alias(c) for c in ("grupo", "id_fnet", "rotulo")])
    return rows.withColumn("rotulo", strip(F.col("rotulo"))).filter("rotulo <> ''")
