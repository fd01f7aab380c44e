"""Text functions; arguments that aren't text become text first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import ColumnLike, as_text, col, is_text, once, string

_MOST = (1 << 31) - 1
_BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _text(x: ColumnLike) -> Column:
    return string(x)


def _literal(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _whole(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def _letter_upper(c: Column) -> Column:
    """Of one letter: as one letter; the title form where the upper one is longer; or as it is."""
    one = lambda x: F.when(F.char_length(x) == 1, x)
    return F.coalesce(one(F.upper(c)), one(F.initcap(c)), c)


def _upper(x: Column) -> Column:
    whole = F.upper(x)  # it is longer where a letter has become several
    return F.when(F.char_length(whole) == F.char_length(x), whole).otherwise(F.array_join(F.transform(F.split(x, ""), _letter_upper), ""))


def uppercase(x: ColumnLike) -> Column:
    """By Unicode's simple case mapping, letter by letter: the length stays, so ß stays."""
    return as_text(once(x, _upper) if is_text(x) else _upper(_text(x)))


def lowercase(x: ColumnLike) -> Column:
    """By Unicode's simple case mapping: Σ becomes σ at a word's end, too, and İ becomes i."""
    x = F.replace(F.replace(_text(x), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))
    return as_text(F.lower(x))


def trim(x: ColumnLike) -> Column:
    """White space of any kind goes from both ends; what is inside stays."""
    return as_text(F.regexp_replace(F.regexp_replace(_text(x), f"^{_BLANKS}", ""), f"{_BLANKS}$", ""))


def length(x: ColumnLike) -> Column:
    """Characters, as a double."""
    return F.length(_text(x)).cast("double")


def substring(x: ColumnLike, start: Column | int, count: Column | int | None = None) -> Column:
    """From a 0-based start; a negative one counts from the end, and at most back to the beginning."""
    n = F.lit(_MOST) if count is None else F.greatest(_whole(count), F.lit(0))
    if isinstance(start, Column):
        begin = lambda s: F.when(_whole(start) < 0, F.greatest(F.length(s) + _whole(start), F.lit(0))).otherwise(_whole(start))
        return as_text(once(_text(x), lambda s: F.substring(s, begin(s) + 1, n)))
    if start >= 0:
        return as_text(F.substring(_text(x), F.lit(int(start) + 1), n))
    return as_text(F.substring(F.substring(_text(x), F.lit(int(start)), F.lit(_MOST)), F.lit(1), n))


def substring_before(x: ColumnLike, mark: Column | str) -> Column:
    """The whole text if the mark isn't in it."""
    return as_text(F.call_function("substring_index", _text(x), _literal(mark), F.lit(1)))


def substring_after(x: ColumnLike, mark: Column | str) -> Column:
    """The whole text if the mark isn't in it."""
    if isinstance(mark, str):
        return as_text(F.regexp_replace(_text(x), "(?s)^.*?" + re.escape(mark), "") if mark else _text(x))
    at = lambda s: F.call_function("instr", s, mark)
    return as_text(once(_text(x), lambda s: F.when(at(s) == 0, s).otherwise(F.substring(s, at(s) + F.length(mark), F.lit(_MOST)))))


def contains(x: ColumnLike, part: Column | str) -> Column:
    return F.contains(_text(x), _literal(part))


def join(items: ColumnLike, separator: Column | str = ",") -> Column:
    """Elements as text; nothing is ""."""
    return F.array_join(F.transform(col(items), string), separator if isinstance(separator, str) else separator)


def pad(x: ColumnLike, width: Column | int, filler: Column | str = " ") -> Column:
    """To the right, up to a width in bytes, with the whole filler for each byte that lacks; never cut."""
    filler = _literal(filler)
    filler = F.when(filler == "", F.lit(" ")).otherwise(filler)
    return as_text(once(_text(x), lambda s: F.concat(s, F.repeat(filler, F.greatest(_whole(width) - F.octet_length(s), F.lit(0))))))


def split(x: ColumnLike, separator: str) -> Column:
    """By a literal separator, with empty parts; by "" into characters."""
    return F.split(_text(x), r"\Q" + separator + r"\E" if separator else "", -1)


def concat(*parts: ColumnLike) -> Column:
    return as_text(F.concat(*map(_text, parts)))
