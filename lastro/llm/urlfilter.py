"""URL filtering by rules and by a ratio of character language models, by DataFrame functions only.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs,
give each character a probability from up to ORDER characters before it: each
order's estimate is mixed with the next lower order's, the more so the less the
context has been seen. A URL's score is the mean, over its characters, of the
difference of the log-likelihoods. The limit between both verdicts is calibrated on
URLs that the models didn't count, one part of PARTS of the labelled ones. With recount
the scores then come from models counted over all labelled URLs, that part included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.llm.common import checkpoint, join_spread

ORDER = 4
#: Observations that the lower order's estimate counts as; letters that the lowest order spreads over.
WEIGHT, LETTERS = 4.0, 256.0
#: Of so many parts of the labelled URLs one calibrates the limit; scores are compared on a grid of this step.
PARTS, GRID = 5, 0.01
PAD = "\u0002"
#: Characters of URLs whose grams a task makes, about.
TASK_CHARS = 250_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(text: str) -> tuple[UrlRule, ...]:
    """Rules like "allow org/, block example.org/es/"."""
    out = []
    for part in text.split(","):
        verdict, where = part.split()
        host, slash, path = where.partition("/")
        out.append(UrlRule(verdict, host, slash + path))
    return tuple(out)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def by_rule(host: Column, path: Column, known: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. The first of equally long rules wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(known), key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _grams(url: Column) -> Column:
    """Each character with the ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), url)
    each = F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return F.when(F.length(url) > 0, each).otherwise(F.array().cast("array<string>"))


def model(labelled: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, ratio: the log-likelihood difference of each gram's last character, for every gram of asked.

    labelled: columns gram, accepted (boolean), n (the URL's copies), one row per character
    of a labelled URL; asked: distinct grams (gram), a written table.
    """
    top = labelled.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    top = checkpoint(top)
    out = asked.withColumns({"pa": F.lit(1 / LETTERS), "pr": F.lit(1 / LETTERS)})
    for k in range(ORDER + 1):
        end = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = top.groupBy(end.alias("end")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = seen.groupBy(F.substring("end", 1, k).alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        out = out.withColumns({"end": end, "context": F.substring("gram", ORDER + 1 - k, k)}).join(seen, "end", "left").join(context, "context", "left")
        mixed = {p: (F.coalesce(F.col(n), F.lit(0)) + WEIGHT * F.col(p)) / (F.coalesce(F.col(c), F.lit(0)) + WEIGHT) for p, n, c in (("pa", "a", "ca"), ("pr", "r", "cr"))}
        out = out.select("gram", *[e.alias(p) for p, e in mixed.items()])
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def filter_urls(pages: DataFrame, known: tuple[UrlRule, ...], page_id: str = "page_id", url: str = "url", recount: bool = False) -> DataFrame:
    """Judges every URL: by the longest rule that fits, else by the models learned from the URLs that rules judge.

    Returns one row per row of pages: page_id, host, path, rule, verdict (allow or block),
    score (mean log-likelihood difference; 0 for an empty URL). A null URL counts as empty.
    recount: the final scores are by models of all labelled URLs, else by those that calibrate
    nothing. Equal URLs are scored once but counted as often as they occur. Without labelled URLs of
    both verdicts all scores are 0; a score at the limit or above is allowed. URLs may be of any
    length. Repeated rows and null ids are each returned; other columns are ignored whatever
    their names.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url")).withColumns({"host": host, "path": path})
    name, verdict = by_rule(F.col("host"), F.col("path"), known)
    rows = rows.withColumns({"rule": name, "judged": verdict})
    calibrates = F.pmod(F.xxhash64("url"), F.lit(PARTS)) == 0
    urls = rows.groupBy("url").agg(F.first("judged").alias("judged"), F.count(F.lit(1)).alias("n"))
    urls = checkpoint(urls.withColumns({"accepted": F.col("judged") == "allow", "calibrates": calibrates, "id": F.monotonically_increasing_id()}))
    tasks = (urls.agg(F.sum(F.length("url"))).first()[0] or 0) // TASK_CHARS + 1
    chars = checkpoint(urls.repartition(tasks, "id").select("id", "accepted", "calibrates", "n", F.explode(_grams(F.col("url"))).alias("gram")))
    calibrating = F.col("accepted").isNotNull() & F.col("calibrates")
    learned = chars.filter("accepted is not null and not calibrates")

    def scored(labelled: DataFrame, of: DataFrame, chars: DataFrame) -> DataFrame:
        """urls with scores; chars: their characters. Some grams, such as a scheme's, are in every URL."""
        counts = checkpoint(chars.groupBy("gram").count())
        ratios = model(labelled, counts.select("gram"))
        mean = join_spread(chars.select("id", "gram"), ratios, ["gram"], by="id", counts=counts).groupBy("id").agg(F.avg("ratio").alias("score"))
        return checkpoint(of.join(mean, "id", "left").select("url", "accepted", "calibrates", "judged", "n", F.coalesce("score", F.lit(0.0)).alias("score")))

    if recount:
        limit = _limit(scored(learned, urls.filter(calibrating), chars.filter(calibrating)))
        scores = scored(chars.filter("accepted is not null"), urls, chars)
    else:
        scores = scored(learned, urls, chars)
        limit = _limit(scores.filter(calibrating))
    hot = scores.select("url", F.col("n").alias("count"))
    # A hot URL's rows are dealt by their ids.
    out = join_spread(rows, scores.select("url", "score"), ["url"], by="page_id", counts=hot)
    own = F.when(F.round("score", 9) >= F.lit(limit), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("judged", own).alias("verdict"), "score")


def _limit(scores: DataFrame) -> float:
    """The grid point with the fewest errors, where both verdicts count alike; of several the one nearest to 0.

    The driver gets a row per grid point and verdict, whose number the grid bounds.
    """
    grid = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / GRID)))
    rows = scores.groupBy(grid.cast("int").alias("g")).agg(F.sum(F.when(F.col("judged") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("judged") == "block", F.col("n")).otherwise(0)).alias("b")).collect()
    allowed, blocked = sum(r.a for r in rows), sum(r.b for r in rows)
    if not allowed or not blocked:
        return 0.0
    points = {0: 0.0}
    for g in sorted({r.g for r in rows} | {r.g + 1 for r in rows} | {0}):
        points[g] = sum(r.a for r in rows if r.g < g) / allowed + sum(r.b for r in rows if r.g >= g) / blocked
    return GRID * min(points, key=lambda g: (points[g], abs(g)))
