"""Accent-insensitive phrase search with exact snippets of the original text.

Folding maps one character to one character, so offsets in the folded text are
offsets in the original. Terms are literals: their patterns are made on the driver
and run as Java regexes inside the plan.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.parsing import collapse

#: Words that stand for each other in legal phrasing (fixed values).
CONNECTORS = ("a", "as", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos", "o", "os", "ou")
#: Signs of a prohibition before a term (fixed values).
PROHIBITIONS = (
    "vedad", "vedar", "veda-se", "proibid", "proibir", "nao podera", "nao poderao",
    "nao sera permitid", "nao serao permitid", "nao autorizad", "impedid",
    "abster-se", "excluid", "nao podem", "nao pode",
)
#: Characters of context on each side, and before a term where a prohibition counts (fixed values).
CONTEXT, PROHIBITION_WINDOW = 160, 120


def fold_text(text: str) -> str:
    """The same folding for text on the driver."""
    return "".join(_folded(c) for c in text)


def _folded(ch: str) -> str:
    return unicodedata.normalize("NFD", (ch.lower() or ch)[0])[0]


@cache
def _fold_table() -> tuple[str, str]:
    pairs = [(chr(i), _folded(chr(i))) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    changed = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def fold(c: Column) -> Column:
    """Lower case without accents, of the same length."""
    return F.translate(c, *_fold_table())


def tokens(term: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", fold_text(term))


def _searchable(term: str) -> list[str]:
    found = tokens(term)
    if not found:
        raise ValueError(f"nothing to search for in {term!r}")
    return found


def _stem(token: str) -> str:
    return token[:-1] if len(token) > 3 and token[-1] == "s" else token


def term_pattern(term: str, flexible: bool = True, connectors: tuple[str, ...] = CONNECTORS) -> str:
    """Tokens in order with anything but letters and digits between, not inside longer words.

    flexible: any connector for a connector, and either number of other words.
    """
    each = []
    for t in _searchable(term):
        if not flexible:
            each.append(t)
        elif t in connectors:
            each.append("(?:" + "|".join(connectors) + ")")
        else:
            each.append(_stem(t) + "s?")
    return "(?<![0-9a-z])" + "[^0-9a-z]*".join(each) + "(?![0-9a-z])"


def prefilter_token(term: str, connectors: tuple[str, ...] = CONNECTORS) -> str | None:
    """A plain substring of every match; none if the term is connectors alone."""
    content = [t for t in _searchable(term) if t not in connectors]
    return _stem(max(content, key=len)) if content else None


def has_term(norm: Column, term: str, flexible: bool = True) -> Column:
    """Whether a folded text matches: a plain substring test first, then the pattern."""
    plain, found = prefilter_token(term), norm.rlike(term_pattern(term, flexible))
    return found if plain is None else F.contains(norm, F.lit(plain)) & found


def has_terms(norm: Column, terms: list[str], every: bool = False, flexible: bool = True) -> Column:
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [has_term(norm, t, flexible) for t in terms])


def matched_terms(norm: Column, terms: list[str], flexible: bool = True) -> Column:
    return F.array_compact(F.array(*[F.when(has_term(norm, t, flexible), F.lit(t)) for t in terms]))


def prohibited(norm: Column, start: Column, window: int = PROHIBITION_WINDOW) -> Column:
    """Whether a sign of prohibition stands in the window before an offset of a folded text."""
    begin = F.greatest(start - window, F.lit(0))
    before = F.regexp_replace(F.substring(norm, begin + 1, start - begin), r"(?U)[\s\x1c-\x1f]+", " ")
    return before.rlike("|".join(map(re.escape, PROHIBITIONS)))


def places(between: Column, hits: Column) -> Column:
    """Start and end of each match, from what stands between matches and the matches."""
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    lengths = F.transform(steps, lambda s: F.struct(F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("hit")))
    kind = "struct<at:int,out:array<struct<start:int,stop:int>>>"
    start = F.from_json(F.lit('{"at":0,"out":[]}'), kind)

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + s["gap"]
        b = a + s["hit"]
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("stop")))).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def count_occurrences(norm: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(norm, F.lit(f"({pattern})"), 1))


def occurrences(df: DataFrame, norm: str, patterns: list[str], into: list[str], first: int | None = None, within: str | list[str | None] | None = None) -> DataFrame:
    """Adds, for each pattern, the array of its leftmost matches (start, stop) in a folded column.

    first: the first so many alone; the text after them is not searched again. within: a
    substring of every match (of every pattern, or one for each), tested before the pattern.
    """
    # Split and matches become columns of their own, so that no lambda repeats a regex.
    whole, parts, steps = F.col(norm), {}, {}
    each = within if isinstance(within, list) else [within] * len(patterns)
    for name, p, plain in zip(into, patterns, each, strict=True):
        between = F.split(whole, p, -1 if first is None else first + 1)
        parts[f"{name}_between"] = between if plain is None else F.when(F.contains(whole, F.lit(plain)), between).otherwise(F.array(whole))
    for name, p in zip(into, patterns, strict=True):
        # Up to the last match's end; a match found there ends where it ended in the whole text.
        upto = F.left(whole, F.length(whole) - F.length(F.element_at(f"{name}_between", -1)))
        steps[f"{name}_hits"] = F.regexp_extract_all(upto, F.lit(f"({p})"), 1)
    out = df.withColumns(parts).withColumns(steps)
    return out.withColumns({n: places(F.col(f"{n}_between"), F.col(f"{n}_hits")) for n in into}).drop(*parts, *steps)


def snippets(df: DataFrame, text: str, norm: str, terms: list[str], into: str = "trechos", most: int = 3, context: int = CONTEXT, flexible: bool = True) -> DataFrame:
    """Adds the first `most` snippets (at least one), in the order of terms and places; a place counts once.

    Each is a struct texto, match, inicio, fim, posicao_documento, possivel_vedacao. Don't filter
    on this column; snippet_rows() drops rows without snippets.
    """
    most = max(1, most)
    names = [f"{into}_{i}" for i in range(len(terms))]
    # At most `most` - 1 places are taken when a match is looked at, so 2 * most of each term are enough.
    out = occurrences(df, norm, [term_pattern(t, flexible) for t in terms], names, first=2 * most, within=[prefilter_token(t) for t in terms])
    kind = "array<struct<start:int,stop:int>>"

    def first(acc: Column, s: Column) -> Column:
        full = (F.size(acc) >= most) | F.exists(acc, lambda o: o["start"] == s["start"])
        return F.when(full, acc).otherwise(F.concat(acc, F.array(s)))

    picked = F.aggregate(F.flatten(F.array(*names)), F.from_json(F.lit("[]"), kind), first)
    out = out.withColumn(f"{into}_picked", picked).drop(*names)

    def window(s: Column) -> Column:
        begin = F.greatest(s["start"] - context, F.lit(0))
        return F.struct(
            F.substring(text, begin + 1, s["start"] - begin).alias("before"), F.substring(text, s["start"] + 1, s["stop"] - s["start"]).alias("hit"),
            F.substring(text, s["stop"] + 1, F.lit(context)).alias("after"), s["start"].alias("start"), prohibited(F.col(norm), s["start"]).alias("flag"),
        )

    def tidy(s: Column) -> Column:
        before, after = collapse(s["before"]), collapse(s["after"])
        return F.struct(
            F.nullif(before, F.lit("")).alias("before"), collapse(s["hit"]).alias("hit"), F.nullif(after, F.lit("")).alias("after"), s["start"], s["flag"],
        )

    def joined(s: Column) -> Column:
        lead, tail = F.coalesce(F.concat(s["before"], F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit(" "), s["after"]), F.lit(""))
        return F.struct(
            F.concat(lead, s["hit"], tail).alias("texto"), s["hit"].alias("match"), F.length(lead).alias("inicio"), (F.length(lead) + F.length(s["hit"])).alias("fim"),
            s["start"].alias("posicao_documento"), s["flag"].alias("possivel_vedacao"),
        )

    # Small windows are cut first; each step reads what the one before has made.
    return out.withColumn(into, F.transform(F.transform(F.transform(f"{into}_picked", window), tidy), joined)).drop(f"{into}_picked")


def snippet_rows(df: DataFrame, *keep: str, into: str = "trechos") -> DataFrame:
    """keep columns and one row per snippet.

    An outer generator: for an inner one over a column Catalyst infers a filter on the array's
    size, and pushes it below all that made the array, where every use of it is made anew.
    """
    return df.select(*keep, F.inline_outer(into)).filter("posicao_documento is not null")


def highlighted(snippet: Column, left: str = "«", right: str = "»") -> Column:
    """A snippet's text with marks around the match."""
    t = snippet["texto"]
    return F.concat(F.substring(t, F.lit(1), snippet["inicio"]), F.lit(left), snippet["match"], F.lit(right), F.substring(t, snippet["fim"] + 1, F.length(t)))
