"""JSON text functions: response normalisation and status (COL-5), row to JSON (COL-7),
defaulting integer casts with a quarantine column (COL-8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# The fence the model wraps JSON answers in.
FENCE_OPEN = "```json\n"
FENCE_CLOSE = "\n```"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def response_body(text) -> Column:
    """Strip whitespace; remove the fence only when it both opens and closes the text."""
    s = strip_ws(F.coalesce(_c(text), F.lit("")))
    fenced = s.startswith(FENCE_OPEN) & s.endswith(FENCE_CLOSE)
    n = len(FENCE_OPEN) + len(FENCE_CLOSE)
    inner = F.when(F.length(s) >= n,
                   F.substr(s, F.lit(len(FENCE_OPEN) + 1), F.length(s) - n)).otherwise(F.lit(""))
    return F.when(fenced, inner).otherwise(s)


def response_status(text) -> Column:
    """COL-5 status of one model answer.

    ``empty``: blank, or a fence with nothing inside (means "no change", value ``{}``);
    ``ok``: a JSON object; ``not_object``: valid JSON of another type; ``invalid``: not JSON.
    """
    s = strip_ws(F.coalesce(_c(text), F.lit("")))
    body = response_body(text)
    v = F.try_parse_json(body)
    return (F.when(s == "", F.lit("empty"))
            .when(body == "", F.lit("empty"))
            .when(v.isNull() | ~whole_json(body), F.lit("invalid"))
            .when(F.schema_of_variant(v).startswith("OBJECT"), F.lit("ok"))
            .otherwise(F.lit("not_object")))


def whole_json(body) -> Column:
    """True when ``body`` is exactly one JSON value (whitespace around it allowed).

    Spark's parsers stop after the first complete value and ignore what follows
    (``{"a": 1}}`` parses); a strict reader rejects trailing data. Wrapping the body as
    ``[body, 1]`` turns any trailing text into a parse error or an extra element.
    """
    w = F.concat(F.lit("["), _c(body), F.lit(", 1]"))
    return F.coalesce((F.json_array_length(w) == 2) & (F.get_json_object(w, "$[1]") == "1"), F.lit(False))


def resolved_object(text) -> Column:
    """JSON text of the accepted object: the body for ``ok``, ``{}`` for ``empty``, else null."""
    st = response_status(text)
    return F.when(st == "ok", response_body(text)).when(st == "empty", F.lit("{}"))


def row_json(df, exclude=()) -> Column:
    """COL-7: JSON of all columns but ``exclude``; nulls are written, not dropped."""
    cols = [c for c in df.columns if c not in set(exclude)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def int_or_default(raw, default: int = -1) -> Column:
    """COL-8: missing -> ``default``; numeric text -> int; anything else -> null (see ``quarantine``)."""
    r = _c(raw)
    return F.when(r.isNull(), F.lit(default)).otherwise(r.try_cast("int"))


def quarantine(raw) -> Column:
    """The raw text of a present value that does not cast to int, else null."""
    r = _c(raw)
    return F.when(r.isNotNull() & r.try_cast("int").isNull(), r)
