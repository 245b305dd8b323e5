"""Similarity and merging of token sequences, and templates as patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.config import PARAM


def similarity(template: Column, tokens: Column, include_params: bool = False, param: str = PARAM) -> Column:
    """struct(sim, params): share of positions of the template that equal the token (wildcards count only
    with ``include_params``), and its number of wildcards. Empty: (1, 0). Null for unequal lengths."""
    n = F.size(template)
    params = F.size(F.filter(template, lambda t: t == param))
    same = F.size(F.filter(F.zip_with(template, tokens, lambda t, x: (t != param) & (t == x)), lambda x: x))
    hits = same + params if include_params else same
    sim = F.when(n == 0, 1.0).otherwise(hits / n)
    return F.when(n == F.size(tokens), F.struct(sim.alias("sim"), params.alias("params")))


def merge(template: Column, tokens: Column, param: str = PARAM) -> Column:
    """Equal tokens stay, others become wildcards; unequal lengths are an error."""
    merged = F.zip_with(template, tokens, lambda t, x: F.when(t == x, t).otherwise(param))
    return F.when(F.size(template) == F.size(tokens), merged).otherwise(F.raise_error(F.lit("token sequences differ in length")))


def collapse(tokens: Column, param: str = PARAM) -> Column:
    """Without a wildcard right after a wildcard."""
    before = lambda i: F.get(tokens, i - 1)
    kept = F.transform(tokens, lambda t, i: F.when((t == param) & F.coalesce(before(i) == param, F.lit(False)), F.lit(None)).otherwise(t))
    return F.filter(kept, lambda t: t.isNotNull())


def lexical_template(tokens: Column, gaps: Column, static: Column, param: str = PARAM) -> Column:
    """Raw text with runs of varying tokens replaced by one wildcard; text between tokens always stays."""

    def piece(g: Column, i: Column) -> Column:
        was = F.when(i == 0, True).otherwise(F.get(static, i - 1))
        token = F.when(F.get(static, i), F.get(tokens, i)).when(was, param).otherwise("")
        return F.concat(g, F.when(i < F.size(tokens), token).otherwise(""))

    return F.array_join(F.transform(gaps, piece), "")


def positional_template(tokens: Column, static: Column, param: str = PARAM) -> Column:
    return F.array_join(collapse(F.zip_with(tokens, static, lambda t, s: F.when(s, t).otherwise(param)), param), " ")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-&#~])", r"\\$1")


def pattern_of(template: Column, anchor: Column, param: str = PARAM) -> Column:
    """Anchored pattern with a lazy capture for each wildcard and commas dropped; null without anchor."""
    return F.when(anchor, F.concat(F.lit(r"(?d)\A"), F.array_join(F.transform(literals(template), escape), "(.*?)"), F.lit(r"\z")))


def literals(template: Column) -> Column:
    """What stands around the wildcards of a template, without commas: one part more than wildcards."""
    return F.split(F.replace(template, F.lit(","), F.lit("")), r"<\*>", -1)


def capture(template: Column, line: Column, anchor: Column) -> Column:
    """What stands at the wildcards of a line (both without commas, the line trimmed): array, or null if
    the line doesn't match."""
    return capture_between(literals(template), line, anchor)


def capture_between(parts: Column, line: Column, anchor: Column) -> Column:
    """The same with the template's ``literals``. Every inner literal is taken at its earliest place and the
    last one as the end, which gives the lazy pattern's captures in linear time; only where a line break is
    in play, which a capture can't cross, the pattern itself decides. ``parts`` and ``line`` are used many
    times, so they should be columns."""
    n = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.get(parts, n - 1)
    start = F.struct((F.length(first) + 1).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("caps"))

    def step(s: Column, lit: Column) -> Column:
        found = F.when(F.length(lit) == 0, s["at"]).otherwise(F.call_function("locate", lit, line, s["at"]))
        ok = s["ok"] & (found > 0)
        caps = F.when(ok, F.concat(s["caps"], F.array(F.substring(line, s["at"], found - s["at"])))).otherwise(s["caps"])
        return F.struct(F.when(ok, found + F.length(lit)).otherwise(s["at"]).alias("at"), ok.alias("ok"), caps.alias("caps"))

    def finish(s: Column) -> Column:
        end = F.length(line) - F.length(last)
        fits = s["ok"] & F.startswith(line, first) & F.endswith(line, last) & (end + 1 >= s["at"])
        return F.when(fits, F.concat(s["caps"], F.array(F.substring(line, s["at"], end - s["at"] + 1))))

    scan = F.aggregate(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), start, step, finish)
    plain = F.when(n == 1, F.when(line == first, F.array().cast("array<string>"))).otherwise(scan)
    pattern = F.concat(F.lit(r"(?d)\A"), F.array_join(F.transform(parts, escape), "(.*?)"), F.lit(r"\z"))
    groups = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.call_function("regexp_extract", line, pattern, i))
    exact = F.when(F.call_function("rlike", line, pattern), F.when(n == 1, F.array().cast("array<string>")).otherwise(groups))
    breaks = F.contains(line, F.lit("\n")) | F.contains(F.array_join(parts, ""), F.lit("\n"))
    return F.when(anchor, F.when(breaks, exact).otherwise(plain))


def matches(template: Column, line: Column, anchor: Column) -> Column:
    """Whether a line (commas and outer white space aside) is an instance of a template."""
    return capture(template, line, anchor).isNotNull()
