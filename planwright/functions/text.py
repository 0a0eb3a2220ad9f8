"""Drawing text: MTEXT codes, normal forms, keyword patterns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Formatting codes of MTEXT that run up to a semicolon.
_FORMAT = r"\\[ACFHQTWf].*?;"
#: Title words of layouts (plan, section, elevation, details, nodes, machine rooms, arrangement), and the longest title.
TITLES = ("平面图", "剖面图", "立面图", "详图", "大样图", "节点图", "机房图", "布置图")
LONGEST_TITLE = 48
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def _code_points(text: Column) -> Column:
    r"""``\U+XXXX`` -> the character: parts after the first begin with four hex digits, else the code stays."""
    parts = F.split(text, r"\\U\+")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(p.rlike("^[0-9A-Fa-f]{4}"), F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substr(p, F.lit(5)))).otherwise(F.concat(F.lit("\\U+"), p)))
    return F.concat(parts[0], F.array_join(rest, ""))


def decode_mtext(text: Column) -> Column:
    """Formatting codes go, stacks become fractions, toggles and braces go, code points and paragraphs are written out."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _FORMAT, "")
    stacked = r"\\S([^;^\n]*)\^?([^;\n]*);"
    t = F.regexp_replace(t, stacked.replace(r"\^?", r"\^"), "$1/$2")
    t = F.regexp_replace(t, r"\\S([^;\n]*);", "$1")
    t = F.regexp_replace(t, r"\\[LOlo]", "")
    t = F.regexp_replace(F.replace(t, F.lit("\\~"), F.lit(" ")), r"[{}]", "")
    return F.regexp_replace(F.replace(_code_points(t), F.lit("\\P"), F.lit("\n")), r"^\s+|\s+$", "")


def decode_mtext_short(text: Column) -> Column:
    """The shorter form: code points and paragraphs first, no stacks or toggles."""
    t = F.replace(_code_points(F.coalesce(text, F.lit(""))), F.lit("\\P"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _FORMAT, ""), r"[{}]", ""), r"^\s+|\s+$", "")


def _each(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of each text; a few at a time are Python strings, however long a batch of texts is."""
    parts = [pa.array([None if t is None else f(t) for t in texts.slice(lo, 128).to_pylist()], texts.type) for lo in range(0, len(texts), 128)]
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility normal form; Spark has no function for it."""
    return _each(text, lambda t: unicodedata.normalize("NFKC", t))


@F.arrow_udf(StringType())
def match_form(text: pa.Array) -> pa.Array:
    """Compatibility normal form, white space run together, case folded."""
    return _each(text, lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().casefold())


def loose_form(text: Column) -> Column:
    """The match form with range marks as one, then without white space, hyphens, underscores and tildes."""
    # fixed values: range marks, and the ASCII mark that each stands for
    marks = F.translate(match_form(text), "～∼〜至到－—", "~~~~~--")
    return F.regexp_replace(marks, r"[\s\-_~]", "")


def keyword_pattern(keyword: str) -> str:
    """Without regex marks: its words in order with gaps; else itself as a pattern if it is one, or literally."""
    if not re.search(r"[.^$*+?{}\[\]\\|()]", keyword):
        return ".*".join(re.escape(w) for w in keyword.split())
    try:
        re.compile(keyword)
        return keyword
    except re.error:
        return re.escape(keyword)


def matched(text: Column, queries: list[str]) -> Column:
    """The queries that the text has in it, case aside."""
    return F.filter(F.array(*map(F.lit, queries)), lambda q: F.contains(F.lower(text), F.lower(q)))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def looks_like_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{16,}$")


def duration(seconds: Column) -> Column:
    """``250ms``, ``5.0s``, ``2m05.0s``."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 1, F.format_string("%.0fms", seconds * 1000)).when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm%04.1fs", minutes, seconds - minutes * 60))


def shorten(text: Column, most: int = 800, mark: str = "...[truncated]") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def is_title(text: Column) -> Column:
    """A short text with one of the title words."""
    return (F.char_length(text) <= LONGEST_TITLE) & text.rlike("|".join(TITLES))
