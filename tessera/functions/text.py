"""Text column functions: line count, stripping, affix pruning, base names, tokens.

All functions take and return ``Column`` objects built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers the model is asked to wrap code in (prefix, then suffix forms).
CODE_START_MARKERS = ("DELIMITER_CODE_START@", "DELIMITER_CODE_START")
CODE_END_MARKERS = ("@DELIMITER_CODE_END", "DELIMITER_CODE_END")

NL = "\n"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_count(text) -> Column:
    """COL-1: number of newline characters (an unterminated last line is not counted)."""
    t = _c(text)
    return (F.length(t) - F.length(F.regexp_replace(t, NL, ""))).cast("int")


def strip_ws(text) -> Column:
    """Whitespace strip on both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def has_text(text) -> Column:
    """True when the value holds at least one non-whitespace character."""
    return _c(text).rlike(r"\S")


def remove_prefix(text, prefix: str) -> Column:
    t = _c(text)
    return F.when(t.startswith(prefix), F.substring(t, len(prefix) + 1, 1 << 30)).otherwise(t)


def remove_suffix(text, suffix: str) -> Column:
    t = _c(text)
    return F.when(t.endswith(suffix), F.left(t, F.length(t) - len(suffix))).otherwise(t)


def prune_code_delimiters(text) -> Column:
    """COL-6: drop the start marker (with, then without ``@``) and the end marker likewise.

    The removals are chained, so a doubled marker loses both copies, as in the original.
    A missing value becomes the empty string.
    """
    t = F.coalesce(_c(text), F.lit(""))
    for p in CODE_START_MARKERS:
        t = remove_prefix(t, p)
    for s in CODE_END_MARKERS:
        t = remove_suffix(t, s)
    return t


def prune_code_delimiters_array(arr) -> Column:
    """COL-6 over every element of an array column; missing array -> ``[]``."""
    return F.transform(F.coalesce(_c(arr), F.array().cast("array<string>")), prune_code_delimiters)


def base_name(path) -> Column:
    """COL-9: last ``/`` separated segment."""
    return F.element_at(F.split(_c(path), "/"), -1)


def fragments(text, delimiter: str = "\n\n") -> Column:
    """COL-4: split on the delimiter and drop whitespace-only pieces (pieces stay untrimmed)."""
    return F.filter(F.split(_c(text), delimiter), has_text)


def word_tokens(text) -> Column:
    """Whitespace-delimited tokens."""
    return F.regexp_extract_all(_c(text), F.lit(r"\S+"), F.lit(0))


def truncate(arr, n: int) -> Column:
    """COL-15: first ``n`` elements."""
    return F.slice(_c(arr), 1, n)


def percent(x) -> Column:
    """COL-18."""
    return _c(x) * F.lit(100.0)
