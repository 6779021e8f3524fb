"""Term search through a stored inverted index: tokens of folded texts and the documents that have them.

The index is a table of the store whose parts are a range of ids and a bucket of tokens, so new
texts rewrite their ranges alone and a search reads the buckets of its tokens alone. It gives
candidates before any text is read; the terms' patterns then confirm them.

A match of a term covers whole tokens of the text, and each of these is one or more tokens of
the term written together, since nothing need stand between them. So a term asks for one of the
ways to cut its tokens into groups, and in a way for one form of each group.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.text import CONNECTORS, _searchable, _stem
from lastro.store import PART, Store

TOKEN = "[0-9a-z]+"
#: Forms of a term that are looked up at most; a term with more asks for its first tokens alone, and in the end for nothing.
MOST_FORMS = 2048
TABLE, RANGE, BUCKETS = "documento_tokens", 10_000, 16
#: Tasks, and files, that a range's rows are written by.
SLICES = 4


def packed(texts: DataFrame) -> DataFrame:
    """id_fnet and tokens, a text's tokens with blanks between them, each once."""
    found = F.array_distinct(F.regexp_extract_all("texto_norm", F.lit(TOKEN), F.lit(0)))
    return texts.select("id_fnet", F.coalesce(F.array_join(found, " "), F.lit("")).alias("tokens"))


def unpacked(rows: DataFrame) -> DataFrame:
    """token, id_fnet, once for each token; a document without tokens has one row without a token."""
    return rows.select(F.explode(F.split("tokens", " ")).alias("token"), "id_fnet").withColumn("token", F.nullif("token", F.lit("")))


def index_texts(store: Store, texts: DataFrame) -> list[str]:
    """Indexes texts (id_fnet, texto_norm); what the index had of these documents goes. Returns the parts that were rewritten."""

    def whole_ranges(touched: set[str], there: set[str]) -> set[str]:
        ranges = {p.partition("-")[0] for p in touched}
        return touched | {p for p in there if p.partition("-")[0] in ranges}

    def anew(target: DataFrame, fresh: DataFrame) -> DataFrame:
        held = target.groupBy("id_fnet").agg(F.array_join(F.collect_list("token"), " ").alias("tokens"))
        return held.join(fresh.select("id_fnet").distinct(), "id_fnet", "left_anti").unionByName(fresh)

    def by_range(rows: DataFrame, touched: set[str]) -> DataFrame:
        # Tokens move packed. A task has few slices of ranges, as it sorts its unpacked rows by their parts.
        slices = SLICES * len({p.partition("-")[0] for p in touched})
        tasks = max(slices, int(store.spark.conf.get("spark.sql.shuffle.partitions")))
        return unpacked(rows.repartition(tasks, F.expr(f"id_fnet div {RANGE // SLICES}"))).filter("token is not null")

    # A document without tokens stands in its range too, so that what it had goes.
    return store.merge(TABLE, packed(texts), ["token", "id_fnet"], how=anew, widen=whole_ranges, unpack=unpacked, deal=by_range)


def _variants(token: str, flexible: bool) -> list[str]:
    if not flexible:
        return [token]
    return list(CONNECTORS) if token in CONNECTORS else [_stem(token), _stem(token) + "s"]


def forms(term: str, flexible: bool = True) -> list[list[list[str]]]:
    """The ways to cut a term's tokens into groups, each a list of groups, each the forms that a group may have; none: nothing can be asked for."""
    each = [_variants(t, flexible) for t in _searchable(term)]

    def group(a: int, b: int) -> list[str]:
        return sorted({"".join(p) for p in product(*each[a:b])})

    def count(a: int, b: int) -> int:
        n = 1
        for v in each[a:b]:
            n *= len(v)
        return n

    def ways(upto: int) -> list[list[tuple[int, int]]]:
        cuts = [[i + 1 for i in range(upto - 1) if bits >> i & 1] for bits in range(1 << (upto - 1))]
        return [list(zip([0, *c], [*c, upto], strict=True)) for c in cuts]

    for upto in range(len(each), 0, -1):
        if 1 << (upto - 1) <= MOST_FORMS and sum(count(a, b) for way in ways(upto) for a, b in way) <= MOST_FORMS:
            whole = upto == len(each)
            # Of a term that is cut short, the last group may go on in the text, so only groups before it are known.
            kept = [way if whole else way[:-1] for way in ways(upto)]
            return [] if any(not way for way in kept) else [[group(a, b) for a, b in way] for way in kept]
    return []


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def candidates(store: Store, terms: list[str], every: bool = False, flexible: bool = True) -> DataFrame | None:
    """id_fnet of the documents that may have one of the terms, or all of them; None if a term that counts asks for nothing."""
    asked = {t: forms(t, flexible) for t in dict.fromkeys(terms)}
    known = {t: ways for t, ways in asked.items() if ways}
    if not known or (len(known) < len(asked) and not every):
        return None
    spark = store.spark
    wanted = [(k, w, len(way), g, token) for k, ways in enumerate(known.values()) for w, way in enumerate(ways) for g, group in enumerate(way) for token in group]
    table = spark.createDataFrame(wanted, "term int, way int, groups int, part int, token string")
    tokens = sorted({w[-1] for w in wanted})
    buckets = {str(r[0]) for r in spark.createDataFrame([(t,) for t in tokens], "token string").select(bucket(F.col("token"))).distinct().collect()}  # BUCKETS at most
    rows = store.read(TABLE, only=lambda p: p.partition("-")[2] in buckets).filter(F.col("token").isin(tokens))
    # The table comes from the terms alone and has MOST_FORMS rows for each at most.
    hits = rows.join(F.broadcast(table), "token").groupBy("id_fnet", "term", "way", "groups").agg(F.count_distinct("part").alias("n")).filter("n = groups")
    found = hits.groupBy("id_fnet").agg(F.count_distinct("term").alias("n"))
    return found.filter(F.col("n") == len(known) if every else F.lit(True)).select("id_fnet")


def texts_of(store: Store, chosen: DataFrame) -> DataFrame:
    """documento_textos of chosen documents (id_fnet): only the parts that they lie in are read."""
    from lastro import schema

    parts = {r[0] for r in chosen.select(schema.part("documento_textos").alias(PART)).distinct().collect()}  # as many as the table has parts
    return store.read("documento_textos", only=parts.__contains__).join(chosen, "id_fnet", "left_semi")
