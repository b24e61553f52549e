"""One-pass lexer for Java-like sources (COL-2, COL-16, COL-17), in Arrow batches.

``TOKEN`` cuts a text into comments, literals (text blocks, strings, characters), names and single signs. Every
alternative is written with possessive repeats, so a token of any length is read once, without backtracking or
recursion: a literal of many megabytes costs its length. Small state machines read the tokens:

* declared (COL-16): ``public``, modifiers, ``class`` or ``interface``, name. Enums, records, annotations and types
  that are not public are left out.
* used (COL-17): a type name with its nested type arguments, a variable name, then ``=``, ``;``, ``,`` or ``)``: the type of
  a field, parameter or local variable. Array and qualified types, catch parameters and for-each variables are left out.

An unterminated comment or text block ends with the text; a quote without its partner on the line is a sign.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)"
_LINE = r"//[^\n]*+"
_TEXT = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+(?:"""|\Z)'
_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_CHAR = r"'(?:\\[^\n']{1,6}|\\'|[^'\\\n])'"
SKIP = "|".join((_BLOCK, _LINE, _TEXT, _STRING, _CHAR))
TOKEN = re.compile(rf"(?P<skip>{SKIP})|(?P<name>(?:[^\W\d]|\$)[\w$]*+)|\S")
_SKIPPED = re.compile(SKIP)
# Words of the language that stand between ``public`` and a type's kind, and the kinds taken.
MODIFIERS = {"abstract", "final", "static", "sealed", "non", "-", "strictfp"}
KINDS = {"class", "interface"}


def blank(text: str) -> str:
    """The text with a blank in place of every comment and literal."""
    return _SKIPPED.sub(" ", text)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of names and signs."""
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "skip"]


def declared(found: list[tuple[str, int, int]]) -> list[str]:
    """Names of public classes and interfaces, in text order."""
    out, state = [], None
    for token, _, _ in found:
        if state == "kind":
            if token[0].isalpha() or token[0] in "_$":
                out.append(token)
            state = None
        elif token == "public":
            state = "public"
        elif state == "public" and token in KINDS:
            state = "kind"
        elif token not in MODIFIERS:
            state = None
    return out


def _argument_ends(found: list[tuple[str, int, int]]) -> dict[int, int]:
    """For every ``<`` that closes as type arguments, the index after its ``>``; one pass with a stack."""
    ends, opened = {}, []
    for k, (token, _, _) in enumerate(found):
        if token == "<":
            opened.append(k)
        elif token == ">":
            if opened:
                ends[opened.pop()] = k + 1
        elif not (token[0].isalnum() or token[0] in "_$,.?[]"):
            opened.clear()  # no sign of type arguments: what is open is a comparison
    return ends


def used(text: str, found: list[tuple[str, int, int]], with_args: bool = False) -> list[str]:
    """Distinct type texts in order; with ``with_args`` also the raw type and the arguments of generics."""
    out: dict[str, None] = {}
    more: list[str] = []
    ends = _argument_ends(found)
    word = lambda k: found[k][0] if 0 <= k < len(found) else ""
    for k, (token, start, end) in enumerate(found):
        if not token[0].isupper() or word(k - 1) == ".":
            continue
        caught = word(k - 1) == "(" and word(k - 2) == "catch" or word(k - 1) == "final" and word(k - 2) == "(" and word(k - 3) == "catch"
        if caught:
            continue
        after = k + 1
        if word(after) == "<":
            after = ends.get(after)
            if after is None:
                continue
        name = word(after)
        if not name or not (name[0].islower() or name[0] in "_$") or word(after + 1) not in ("=", ";", ",", ")"):
            continue
        whole = text[start:found[after - 1][2]]
        out[whole] = None
        if with_args and after > k + 1:
            more.append(token)
            more += [t for j, (t, _, _) in enumerate(found[k + 1:after], k + 1) if t[0].isupper() and word(j - 1) in ("<", ",")]
    return list(dict.fromkeys([*out, *more]))


_UDFS: dict = {}


def _column(name: str, one, text) -> Column:
    """``one(text)`` as a column of arrays; a null text gives null."""
    if name not in _UDFS:  # created lazily: a pandas UDF needs an active session
        _UDFS[name] = F.pandas_udf(lambda texts: pd.Series([None if t is None else one(t) for t in texts]), "array<string>")
    ship(SparkSession.getActiveSession())
    return _UDFS[name](F.col(text) if isinstance(text, str) else text)


def java_declared(text) -> Column:
    return _column("declared", lambda t: declared(tokens(t)), text)


def java_used(text, with_type_args: bool = False) -> Column:
    return _column(f"used{with_type_args}", lambda t: used(t, tokens(t), with_type_args), text)
