"""Secret scans over a trigram inverted index, by DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams that every match contains:
its parse is walked for runs of literals; optional parts and alternations multiply
the strings a run may be, and each such string asks for all of its trigrams. The
index posts documents under those trigrams (of the text with A-Z lower-cased). A
rule's postings are intersected within a string and united over strings; the rule's
regex then runs over the candidates alone. A rule without a mandatory trigram is
scanned for in every text.

Matches are worked on CHUNK at a time, so that the work on a text grows with its matches
and not with their square.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings of a literal run at most; beyond that the run asks for nothing.
MOST_STRINGS = 64
#: Matches that are counted on from one to the next at once.
CHUNK = 128


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: regex; group: the part whose length counts; least: its characters at least."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules (fixed values).
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds: key files, providers' tokens, signed tokens, credentials in addresses. None has a repeated
#: group, which Java's engine would descend into, nor a start that can lie inside a run that another start has read.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY-----", 0, 27),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 0, 26),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("stripe", r"(sk|rk)_live_[A-Za-z0-9]+", 0, 32),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 0, 40),
    Rule("address", r"://[A-Za-z0-9._%+-]+:([^\x00-\x20/@:]+)@", 1, 3),
)
RULES = BASE + ADDED


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _low(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _strings(items) -> set[str] | None:
    """All strings that a parsed sequence may be, if they are few."""
    found = {""}
    for what, arg in items:
        if what is op.LITERAL:
            more = {_low(arg)}
        elif what is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = {_low(v) for _, v in arg}
        elif what is op.SUBPATTERN:
            more = _strings(arg[3])
        elif what is op.BRANCH:
            each = [_strings(b) for b in arg[1]]
            more = None if None in each else set().union(*each)
        elif what is op.MAX_REPEAT and arg[1] is not op.MAXREPEAT and arg[1] <= 4:
            one = _strings(arg[2])
            more = None
            if one is not None:
                runs = [{""}]
                for _ in range(arg[1]):
                    runs.append({a + b for a in runs[-1] for b in one})
                more = set().union(*runs[arg[0] :])
        else:
            more = None
        if more is None:
            return None
        found = {a + b for a in found for b in more}
        if len(found) > MOST_STRINGS:
            return None
    return found


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """A conjunction of disjunctions of trigram sets that every match satisfies; empty: no mandatory trigram.

    Patterns without flags are understood.
    """
    query: list[list[list[str]]] = []

    def close(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run):
            sets = sorted({frozenset(trigrams(s)) for s in run}, key=lambda x: (len(x), sorted(x)))
            # A string that asks for all that another asks for, and more, adds nothing.
            query.append([sorted(x) for i, x in enumerate(sets) if not any(y < x for y in sets[:i])])

    def walk(items) -> None:
        run = {""}
        for item in items:
            own = _strings([item])
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = {""}
            what, arg = item
            if what is op.SUBPATTERN:
                walk(arg[3])
            elif what is op.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(list(parser.parse(pattern)))
    return query


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK elements at most."""
    n = F.ceil(F.size(items) / F.lit(CHUNK)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(items), 1, 0))


PLACES = "array<struct<start:int,stop:int,part:int>>"


def _run(lengths: Column, at: Column) -> Column:
    """Starts and ends of a few matches from the lengths of gaps, hits and parts, the first gap beginning at `at`."""
    nothing = F.from_json(F.lit("[]"), PLACES)

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        stop = start + s["hit"]
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), s["part"].alias("part")))).alias("out"))

    return F.aggregate(lengths, F.struct(at.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])


def _sums(totals: Column) -> Column:
    """The sum of what stands before each number."""
    none = F.array().cast("array<int>")
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(totals, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches that are long enough, as structs (start, order, end) in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, 0)
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = _let(whole, lambda hits: F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), (hits if rule.group == 0 else counted).alias("part")))
    lengths = F.transform(steps, lambda s: F.struct(F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("hit"), F.length(s["part"]).alias("part")))

    def place(chunks: Column) -> Column:
        size = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + s["gap"] + s["hit"]))
        return F.flatten(F.zip_with(chunks, _sums(size), _run))

    found = F.filter(_let(_let(lengths, _chunks), place), lambda s: s["part"] >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("end")))


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The index, of the trigrams that rules ask for: rows gram, doc_id."""
    grams = sorted({g for r in rules for part in trigram_query(r.pattern) for s in part for g in s})
    if not grams:
        return docs.select(F.lit("").alias("gram"), "doc_id").limit(0)
    low = docs.select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(held).alias("gram"))


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(kinds, row, strict=True)) for row in rows], pa.schema(list(kinds.items())))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rule (its place in rules) where a rule's trigram query holds."""
    spark = docs.sparkSession
    wanted, parts = [], []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query:
            parts.append((i, len(query)))
        for k, part in enumerate(query):
            for s, grams in enumerate(part):
                wanted += [(i, k, s, len(grams), g) for g in grams]
    terms = spark.createDataFrame(_table(wanted, rule=pa.int32(), part=pa.int32(), string=pa.int32(), size=pa.int32(), gram=pa.string()))
    whole = spark.createDataFrame(_table(parts, rule=pa.int32(), parts=pa.int32()))
    # Both small tables come from the rules alone, so their size doesn't depend on the data. As lists they would start Python workers.
    found = postings(docs, rules).distinct().join(F.broadcast(terms), "gram").groupBy("doc_id", "rule", "part", "string", "size").count().filter("count = size")
    found = found.groupBy("doc_id", "rule").agg(F.count_distinct("part").alias("n"))
    return found.join(F.broadcast(whole), "rule").filter("n = parts").select("doc_id", "rule")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Finds the rules' secrets in every text.

    Returns one row per row of docs: the columns named in carry, doc_id, text, found (an array of structs start,
    order, end by start and rule; code points, end exclusive; order is the rule's place).
    A null text counts as empty. Repeated rows are scanned each for itself; rows with a
    null id can't be posted, so their texts are scanned fully. Other columns of docs are
    ignored whatever their names.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    docs = docs.select(carried.alias("carried"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    indexed = [i for i, r in enumerate(rules) if trigram_query(r.pattern)]
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,order:int,end:int>>")
    docs = docs.withColumn("always", F.array(*[
        F.when(F.col("doc_id").isNull() | F.lit(i not in indexed), F.col("text").rlike(_filled(r))).otherwise(False) for i, r in enumerate(rules)
    ]))
    if indexed:
        asked = candidates(docs.filter("doc_id is not null"), rules).groupBy("doc_id").agg(F.collect_set("rule").alias("asked"))
        docs = docs.join(asked, "doc_id", "left")
    else:
        docs = docs.withColumn("asked", F.array().cast("array<int>"))
    each = []
    for i, r in enumerate(rules):
        run = F.col("always")[i] | F.coalesce(F.array_contains("asked", i), F.lit(False))
        each.append(F.when(run, _spans(F.col("text"), r, i)).otherwise(nothing))
    return docs.select(*[F.col("carried")[c].alias(c) for c in carry], "doc_id", "text", F.array_sort(F.concat(*each)).alias("found"))


def _filled(rule: Rule) -> str:
    """A cheap test that every text with a long enough match passes: a pattern that is one repeated class gets its bound."""
    alone = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.find("]") == len(rule.pattern) - 2 and rule.pattern.endswith("+")
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if alone else rule.pattern


def redact(scanned: DataFrame, mask: str = "[secret]") -> DataFrame:
    """scanned with every span of text replaced by the mask; a span that begins inside another adds a mask only for what lies beyond it."""
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), PLACES).alias("out"))

    def reach(spans: Column, at: Column) -> Column:
        """What of each span lies beyond those before it, as the kept text before it (start, stop) and whether anything does (part)."""

        def step(acc: Column, s: Column) -> Column:
            fresh = s["end"] > acc["at"]
            own = F.struct(acc["at"].alias("start"), F.greatest(s["start"], acc["at"]).alias("stop"), fresh.cast("int").alias("part"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

        return F.aggregate(spans, F.struct(at.alias("at"), start["out"].alias("out")), step, lambda acc: F.filter(acc["out"], lambda s: s["part"] > 0))

    def ends(chunks: Column) -> Column:
        """Where the spans before each chunk end."""
        none = F.array().cast("array<int>")
        step = lambda acc, n: F.struct(F.greatest(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        most = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        return F.aggregate(most, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(spans: Column, at: Column) -> Column:
        """The text from `at` to the end of a chunk's last span, masked; the chunk's own text is cut out first."""

        def cut(kept: Column) -> Column:
            own = F.substring(F.col("text"), at + 1, F.element_at(kept, -1)["stop"] - at)
            return _let(own, lambda t: F.array_join(F.transform(kept, lambda s: F.concat(F.substring(t, s["start"] - at + 1, s["stop"] - s["start"]), F.lit(mask))), ""))

        return _let(reach(spans, at), lambda kept: F.when(F.size(kept) > 0, cut(kept)).otherwise(""))

    last = F.array_max(F.transform("found", lambda s: s["end"]))
    clean = _let(_chunks(F.col("found")), lambda chunks: F.array_join(F.zip_with(chunks, ends(chunks), joined), ""))
    clean = F.concat(clean, F.substring(F.col("text"), last + 1, F.length("text")))
    return scanned.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text"))).drop("found")


def _only(order: int):
    return lambda x: F.when(x == order, x)


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base rules' spans and their digest, and all rules' spans, for every document."""
    found = scan(docs)
    name = F.array(*[F.lit(r.kind) for r in RULES])

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["order"] < len(BASE))
    orders = F.transform("found", lambda s: s["order"])
    counts = [F.size(F.array_compact(F.transform(orders, _only(i)))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
