"""COL-16 / COL-17: declared and used symbol extraction over source text.

Java sources go through the one-pass lexer; any other pattern is a JVM regular expression, as in the bindings
over plain words. Either way a corpus of millions of files is one scan, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer

# Comments and literals, which are blanked before matching. Possessive repeats: linear, and no recursion on long literals.
COMMENT_OR_LITERAL = lexer.SKIP.replace(r"\Z", r"\z")


def strip_comments(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(t, COMMENT_OR_LITERAL, " ")


def declared_symbols(text, pattern: str | None = None, group: int = 1, strip: bool = True) -> Column:
    """All declared names, in text order: public Java types, or what ``pattern`` matches."""
    if pattern is None:
        return lexer.java_declared(text)
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(strip_comments(t) if strip else t, F.lit(pattern), F.lit(group))


def first_symbol(text, pattern: str, group: int = 0) -> Column:
    """First match or ``''``."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, pattern, group)


def used_symbols(text, pattern: str | None = None, group: int = 1, with_type_args: bool = False,
                 strip: bool = True) -> Column:
    """Distinct used type names (Java), or distinct matches of ``pattern``. A generic type keeps its full text
    (``List<Foo>``), as in the original; ``with_type_args`` also yields the raw type and its arguments."""
    if pattern is None:
        return lexer.java_used(text, with_type_args)
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(strip_comments(t) if strip else t, F.lit(pattern), F.lit(group)))
