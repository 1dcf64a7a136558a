"""Text columns: decoding, line splitting, stripping and case folding.

Everything here is a composition of built-in functions, so it stays in the JVM.
Long nested expressions are SQL text: one parse instead of thousands of calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line boundaries of Unicode text.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Unicode white space, and the same as a regex class (needs (?U)).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1C-\x1F]"

# The non-ASCII letters that fold to an ASCII letter without regard to case.
_FOLDS_TO_ASCII = {"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"}


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decode(content: Column, dtype: T.DataType) -> Column:
    """File content as text; invalid UTF-8 becomes U+FFFD."""
    if isinstance(dtype, T.StringType):
        return content
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column, dtype: T.DataType,
              probe_bytes: int | Column | None = None) -> Column:
    """True when the content, or its first ``probe_bytes``, holds a NUL."""
    raw = content.cast("binary") if isinstance(dtype, T.StringType) else content
    probed = raw if probe_bytes is None else F.substring(raw, 1, probe_bytes)
    return F.contains(probed, F.unhex(F.lit("00")))


def split_lines(text: str) -> str:
    """SQL for the array of lines, without line ends and without a last empty line.

    Text with '\\n' only is split on that literal, and so is text that has only
    Windows line ends besides. A search for each of the other breaks is several
    times faster than one regex for all of them.
    """
    whole, last = quote(LINE_BREAK), quote(rf"(?:{LINE_BREAK})\z")

    def rare(t: str) -> str:
        return " OR ".join(f"contains({t}, {quote(c)})" for c in _RARE_BREAKS)

    def plain(t: str) -> str:
        return (f"CASE WHEN endswith({t}, '\\n') THEN split(left({t}, length({t}) - 1), '\\n', -1)"
                f" ELSE split({t}, '\\n', -1) END")

    # A carriage return before such a line end is a break of its own.
    unix = bind(f"replace({text}, '\\r\\n', '\\n')", "unix",
                f"CASE WHEN NOT ({rare('unix')}) THEN {plain('unix')} END")
    windows = f"CASE WHEN contains({text}, '\\r\\n') THEN {unix} END"
    return (
        f"CASE WHEN {text} = '' THEN CAST(array() AS array<string>)"
        f" WHEN NOT ({rare(text)}) THEN {plain(text)}"
        f" ELSE coalesce({windows}, split(regexp_replace({text}, {last}, ''), {whole}, -1)) END")


def count_breaks(text: str) -> str:
    """SQL for the number of line breaks."""
    rare = " OR ".join(f"contains({text}, {quote(c)})" for c in _RARE_BREAKS)
    return (f"CASE WHEN {rare} THEN size(split({text}, {quote(LINE_BREAK)}, -1)) - 1 "
            f"ELSE octet_length({text}) - octet_length(replace({text}, '\\n', '')) END")


def strip(text: str) -> str:
    """SQL that removes Unicode white space at both ends."""
    return f"btrim({text}, {quote(WHITE_SPACE)})"


def fold_case(text: Column) -> Column:
    """Lower case in which every letter that can match an ASCII letter is that letter."""
    folded = text
    for letter, plain in _FOLDS_TO_ASCII.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.lower(F.when(ascii_only, text).otherwise(folded))


def bind_row(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A filter on a column added by ``withColumn`` is pushed below it, and the
    expression is then evaluated once per use. A generator output is not
    inlined, and a one-element ``explode`` stays inside whole-stage codegen.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def bind(value: str, name: str, use: str) -> str:
    """SQL for ``use`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"
