"""Text and number helpers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t"


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def mid(s: Column, start: int, end: int) -> Column:
    """Characters from start to before end, both counted from 0."""
    return F.substring(s, start + 1, max(0, end - start))


def find_char(s: Column, char: str) -> Column:
    """Place of the first char, counted from 0; -1 without one."""
    return F.instr(s, char) - 1


def find_first_of(s: Column, chars: str) -> Column:
    """Place of the first character that is one of chars; -1 without one."""
    return F.regexp_instr(s, F.lit(f"[\\Q{chars}\\E]")) - 1


def find_first_not_of(s: Column, chars: str) -> Column:
    """Place of the first character that is none of chars; -1 without one."""
    return F.regexp_instr(s, F.lit(f"[^\\Q{chars}\\E]")) - 1


def replace_char(s: Column, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def to_upper(s: Column) -> Column:
    """ASCII letters in upper case; others stay."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def trim_left(s: Column) -> Column:
    return F.ltrim(s, F.lit(_BLANKS))


def trim_right(s: Column) -> Column:
    return F.rtrim(s, F.lit(_BLANKS))


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(_BLANKS))


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_extension(path: Column) -> Column:
    """The extension with its dot; empty without one."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(file_extension(path)))


def split_words(s: Column) -> Column:
    """Words between spaces; none in a blank text."""
    return F.filter(F.split(F.btrim(s), " +"), lambda x: x != "")


def to_integer(s: Column) -> Column:
    """The whole number that a text is; null for anything else."""
    return F.when(s.rlike("^[ \\t]*[+-]?[0-9]+[ \\t]*$"), trim(s).try_cast("bigint"))


def to_float(s: Column) -> Column:
    """The number that a text is; null for anything else."""
    return F.when(s.rlike("^[ \\t]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t]*$"), trim(s).try_cast("double"))


def float_text(x: Column) -> Column:
    """Six decimals."""
    return F.format_string("%.6f", x)


def bool_text(x: Column) -> Column:
    return F.when(x, "1").otherwise("0")


def trunc(x: Column) -> Column:
    return x.cast("bigint")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def is_blank(c: Column) -> Column:
    return c.rlike("^[ \\t\\n\\r]$")


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def date_text(t: Column) -> Column:
    return F.date_format(t, "d.M.yyyy")


def time_text(t: Column) -> Column:
    return F.date_format(t, "HH:mm:ss")


def value_text(x: Column) -> Column:
    """A value as text, a missing one as '?'."""
    return F.coalesce(x.cast("string"), F.lit("?"))


def clipped_normal(seed: int, low: float, high: float) -> Column:
    return F.least(F.greatest(F.randn(seed), F.lit(low)), F.lit(high))
