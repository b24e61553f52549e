"""Text operators that work inside the row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..session import ship

INDENT = "    "
_SPACE = " \t\n\x0b\f\r"
#: lines and characters that a worker holds before it hands them on
BATCH_LINES, BATCH_CHARS = 8_192, 1 << 21


def normalise_code_text(text):
    """COL-3 steps 1-3: unescape, break after ``;``/``{`` and around ``}``, collapse blank
    runs, strip."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.replace(t, F.lit('\\"'), F.lit('"'))
    t = F.replace(t, F.lit("\\n"), F.lit("\n"))
    t = F.replace(t, F.lit(";"), F.lit(";\n"))
    t = F.replace(t, F.lit("{"), F.lit("{\n"))
    t = F.replace(t, F.lit("}"), F.lit("\n}\n"))
    t = F.regexp_replace(t, r"\n\s*\n", "\n")
    return strip_ws(t)


def fold_levels(text: str) -> Iterator[tuple[int, str]]:
    """(level, line) of every line of a normalised text, in one pass."""
    level = 0
    for line in text.split("\n"):
        line = line.strip(_SPACE)
        if line.startswith("}"):
            level -= 1
        yield level, INDENT * level + line
        if line.endswith("{"):
            level += 1


def _texts(batches):
    """(key as an array of one, text) of every row that has a text; the texts become Python strings one by one."""
    for b in batches:
        for k, t in enumerate(b.column(1)):
            yield b.column(0).slice(k, 1), t.as_py()


def _rows(keys: list[pa.Array], counts: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    at = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(at), *columns], names=names)


def _line_batches(batches):
    """Rows (key, pos, level, line), handed on in small batches, also within one long text."""
    names = ["key", "pos", "level", "line"]
    keys, counts, pos, level, line, chars = [], [], [], [], [], 0

    def batch():
        return _rows(keys, counts, [pa.array(pos, pa.int32()), pa.array(level, pa.int32()), pa.array(line, pa.string())], names)

    for key, text in _texts(batches):
        if text is None:
            continue
        keys.append(key)
        counts.append(0)
        for k, (at, x) in enumerate(fold_levels(text)):
            counts[-1] += 1
            pos.append(k)
            level.append(at)
            line.append(x)
            chars += len(x)
            if len(line) >= BATCH_LINES or chars >= BATCH_CHARS:
                yield batch()
                keys, counts, pos, level, line, chars = [key], [0], [], [], [], 0
    if line:
        yield batch()


def _text_batches(batches):
    keys, out, chars = [], [], 0
    for key, text in _texts(batches):
        keys.append(key)
        out.append(None if text is None else "\n".join(x for _, x in fold_levels(text)))
        chars += len(out[-1] or "")
        if len(out) >= BATCH_LINES or chars >= BATCH_CHARS:
            yield _rows(keys, [1] * len(keys), [pa.array(out, pa.string())], ["key", "out"])
            keys, out, chars = [], [], 0
    if out:
        yield _rows(keys, [1] * len(keys), [pa.array(out, pa.string())], ["key", "out"])


def _keyed(df: DataFrame, key: str, text: str, scan, columns: str) -> DataFrame:
    ship(df.sparkSession)
    t = df.select(F.col(key).alias("key"), normalise_code_text(text).alias("text"))
    return t.mapInArrow(scan, f"key {t.schema['key'].dataType.simpleString()}, {columns}").withColumnRenamed("key", key)


def normalise_code_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """COL-3 / WIN-4: one row per output line (key, pos, level, line).

    A line starting with ``}`` lowers the level before it is written, one ending with
    ``{`` raises it afterwards; negative levels print no indent but still count. The level is
    carried along the lines of a row, so nothing is shuffled, and a text with a third of all lines is one row like
    any other. Lines leave the worker in batches of bounded size, so its memory does not grow with the partition.
    """
    return _keyed(df, key, text, _line_batches, "pos int, level int, line string")


def normalise_code(df: DataFrame, key: str, text: str, out: str = "normalised") -> DataFrame:
    """COL-3 as a whole-text result, one row in and one row out."""
    return _keyed(df, key, text, _text_batches, "out string").withColumnRenamed("out", out)
