"""Masking, tokens and predicates of one line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.config import PARAM

#: Unicode white space, as a class body and as runs.
WS = r"\p{IsWhite_Space}"
WORD = r"\p{IsAlphabetic}\p{N}_\-"
#: Fixed value: a run of word characters, one ASCII punctuation character, or a run of anything else.
LEX = rf"[{WORD}]+|[\p{{Punct}}&&[^_-]]|[^{WS}{WORD}\p{{Punct}}]+"
#: What these are for ASCII alone, where Java's Unicode classes are slow and not needed.
ASCII_WS, ASCII_LEX = r"\t-\r ", r"[A-Za-z0-9_\-]+|[!-,./:-@\[-^`{-~]|[\x00-\x08\x0E-\x1F\x7F]+"
#: Delimiters that become blanks in the delimited token mode.
DELIMITERS = "=:,{}[]()\"';"
#: Fixed value: ASCII punctuation.
NOISE = r"!-/:-@\[-`{-~"


@dataclass(frozen=True)
class Mask:
    """Matches of ``pattern`` become <label>."""

    pattern: str
    label: str

    def __post_init__(self) -> None:
        if "$" in self.label or "\\" in self.label:
            raise ValueError("a label can't hold $ or a backslash")


#: Default masks, in order; digits and word borders are Unicode.
DEFAULT_MASKS = (
    Mask(r"(?U)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "IP"),
    Mask(r"0x[0-9a-fA-F]+", "HEX"),
    Mask(r"(?U)\b[\-\+]?\d+\b", "NUM"),
)


def is_ascii(line: Column) -> Column:
    return F.octet_length(line) == F.char_length(line)


def _masked(line: Column, masks: tuple[Mask, ...], prefix: str, suffix: str, plain: bool) -> Column:
    for m in masks:
        line = F.regexp_replace(line, m.pattern.removeprefix("(?U)") if plain else m.pattern, f"{prefix}{m.label}{suffix}")
    return line


def mask(line: Column, masks: tuple[Mask, ...] = DEFAULT_MASKS, prefix: str = "<", suffix: str = ">") -> Column:
    return F.when(is_ascii(line), _masked(line, masks, prefix, suffix, True)).otherwise(_masked(line, masks, prefix, suffix, False))


def trim_ws(line: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(line, rf"\A[{WS}]+|[{WS}]+\z", "")


def _split(line: Column, plain: bool) -> Column:
    return F.filter(F.split(line, f"[{ASCII_WS if plain else WS}]+", -1), lambda x: x != "")


def words(line: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.when(is_ascii(line), _split(line, True)).otherwise(_split(line, False))


def whitespace_tokens(line: Column, masks: tuple[Mask, ...] = DEFAULT_MASKS) -> Column:
    parts = [_split(_masked(line, masks, "<", ">", plain), plain) for plain in (True, False)]
    return F.when(is_ascii(line), parts[0]).otherwise(parts[1])


def delimited_tokens(line: Column, masks: tuple[Mask, ...] = DEFAULT_MASKS) -> Column:
    parts = [_split(F.translate(_masked(line, masks, "<", ">", plain), DELIMITERS, " " * len(DELIMITERS)), plain) for plain in (True, False)]
    return F.when(is_ascii(line), parts[0]).otherwise(parts[1])


def content_tokens(line: Column, delimiters: tuple[str, ...] = ()) -> Column:
    """Trimmed, each (perhaps longer) delimiter replaced by a blank, split."""
    line = trim_ws(line)
    for d in delimiters:
        line = F.replace(line, F.lit(d), F.lit(" "))
    return words(line)


def lex(line: Column) -> Column:
    return F.when(is_ascii(line), F.regexp_extract_all(line, F.lit(ASCII_LEX), F.lit(0))).otherwise(F.regexp_extract_all(line, F.lit(LEX), F.lit(0)))


def lex_gaps(line: Column) -> Column:
    """What stands before, between and after the lexical tokens: one more than there are tokens."""
    return F.when(is_ascii(line), F.split(line, ASCII_LEX, -1)).otherwise(F.split(line, LEX, -1))


def is_punct(token: Column) -> Column:
    return token.rlike(r"\A[\p{Punct}&&[^_-]]\z")


def is_compact(line: Column) -> Column:
    """At most one word, six or more lexical tokens, two or more of them punctuation. The gap between two
    words is looked for first, so that few lines are cut into lexical tokens."""
    tokens = lex(line)
    return ~line.rlike(rf"[^{WS}][{WS}]+[^{WS}]") & (F.size(tokens) >= 6) & (F.size(F.filter(tokens, is_punct)) >= 2)


def drain_tokens(line: Column, mode: str) -> Column:
    """Tokens in one of the modes whitespace, delimited and compact (lexical tokens of the unmasked line
    where it is compact, else whitespace)."""
    if mode == "delimited":
        return delimited_tokens(line)
    if mode == "compact":
        return F.when(is_compact(line), lex(line)).otherwise(whitespace_tokens(line))
    if mode == "whitespace":
        return whitespace_tokens(line)
    raise ValueError(f"unknown token mode: {mode}")


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def is_anchor(token: Column) -> Column:
    """Lexical token that isn't punctuation, has no ASCII digit and some letter, number or underscore."""
    return ~is_punct(token) & ~has_digit(token) & token.rlike(r"[\p{IsAlphabetic}\p{N}_]")


def anchor_count(tokens: Column, static: Column) -> Column:
    return F.size(F.filter(F.zip_with(tokens, static, lambda t, s: s & is_anchor(t)), lambda x: x))


def anchor_chars(tokens: Column, static: Column) -> Column:
    """Letters and numbers in static anchors."""
    chars = F.zip_with(tokens, static, lambda t, s: F.when(s & is_anchor(t), F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", ""))).otherwise(0))
    return F.aggregate(chars, F.lit(0), lambda a, x: a + x)


def has_static_anchor(template: Column) -> Column:
    return F.replace(template, F.lit(PARAM), F.lit("")).rlike(rf"[^{NOISE} \t]")


def is_useful_template(template: Column, least: int = 3) -> Column:
    rest = F.regexp_replace(F.replace(template, F.lit(PARAM), F.lit("")), rf"[{NOISE} \t]", "")
    return (F.length(trim_ws(template)) > 0) & (F.length(rest) >= least)


def normalize_ws(text: Column) -> Column:
    return F.array_join(words(text), " ")


def first_number(text: Column) -> Column:
    """First number as a double; null if there is none or its digits aren't ASCII."""
    found = F.regexp_extract(text, r"(?U)-?\d+(\.\d+)?", 0)
    return F.when(found.rlike(r"\A[-0-9.]+\z"), found.try_cast("double"))


def trailing_unit(text: Column) -> Column:
    """ASCII letters at the end, unless that is all."""
    return F.regexp_extract(text, r"(?s)[^A-Za-z]([A-Za-z]+)\z", 1)


def clip(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def format_number(v: Column) -> Column:
    """Integral numbers below 1e15 as integers, else the shortest decimal, never with an exponent."""
    text = v.cast("string")
    sign = F.when(v < 0, "-").otherwise("")
    mantissa = F.regexp_extract(text, r"-?([0-9.]+)E", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)", 1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.when(F.length(padded) > power + 1, F.concat(F.lit("."), F.substring(padded, power + 2, F.length(padded)))).otherwise(""))
    plain = F.when(F.contains(text, F.lit("E")), F.concat(sign, F.when(power < 0, small).otherwise(large))).otherwise(text)
    trimmed = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(trimmed)
