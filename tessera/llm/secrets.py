"""Secret scan: fixed patterns plus sliding-window Shannon entropy per character class.

Kinds, in this order where spans start together: assign, access, hex (patterns), then
entropy_hex, entropy_alnum, entropy_base64 (windows). Candidates for the entropy test are
maximal runs of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters. A run's class is the
narrowest alphabet that holds it (hex of one case, letters and digits, base64); hex of one case
inside a wider run is a candidate of its own. A window of
``WINDOW`` characters slides over the run; its character counts and the sum of c*log2(c) are
kept incrementally, so a step costs O(1). Windows at or above the class's threshold merge
into spans. A candidate is suppressed when it is allow-listed: matched by an ``ALLOW``
pattern (UUIDs, paths and dotted or dashed words, one repeated unit), or of one kind of characters
(lower case, upper case, digits; prose glued together is lower case alone). Hex needs no more. Other
classes need ``MIN_DIGITS`` digits or, within one window, ``ODD_PARTS`` parts that no word or
camel-case name is made of: cut at case changes and digits, a part shorter than three characters or
without a vowel. README gives the recall on random keys and the false hits.

Spans are ``kind:start:end`` in code points, end exclusive, of the whole match. Null texts count as
empty; empty texts have no spans; every input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
WINDOW = 20
#: bits per character over one window, by class
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.6, "entropy_base64": 3.6}
MIN_DIGITS = 3
ODD_PARTS = 3
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"/?([A-Za-z_-]+/)+[A-Za-z_-]*",
    r"[A-Za-z]+([_-][A-Za-z]+)+",
    r"(.{1,8})\1+",
    r"[=_+/-]+",
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: shorter ones cannot hide a longer one
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_HEX_PART = re.compile(r"[0-9a-f]{%d,}|[0-9A-F]{%d,}" % (WINDOW, WINDOW))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WORD = re.compile(r"[0-9]{3}|(?=[A-Za-z]{3}).*[aeiouyAEIOUY]")
_GLUE = [(math.log2(c) * c if c else 0.0) for c in range(WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def char_class(run: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "entropy_hex"
    return "entropy_alnum" if re.fullmatch(r"[A-Za-z0-9]+", run) else "entropy_base64"


def hot_windows(run: str, threshold: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose entropy reaches ``threshold``; O(1) per step."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        total += _GLUE[k + 1] - _GLUE[k]
        counts[c] = k + 1
        if i >= WINDOW - 1:
            if math.log2(WINDOW) - total / WINDOW >= threshold - 1e-9:
                a, b = i - WINDOW + 1, i + 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            out = run[i - WINDOW + 1]
            k = counts[out]
            total += _GLUE[k - 1] - _GLUE[k]
            counts[out] = k - 1
    return spans


def odd_parts(run: str) -> bool:
    """Whether ``ODD_PARTS`` parts that are no words start within one window of ``run``."""
    at = [m.start() for m in _PART.finditer(run) if not _WORD.match(m.group())]
    return any(b - a < WINDOW for a, b in zip(at, at[ODD_PARTS - 1:], strict=False))


def candidates(run: str):
    """(offset, characters, class) of the run and of the hex inside a wider one."""
    kind = char_class(run)
    yield 0, run, kind
    if kind != "entropy_hex":
        for m in _HEX_PART.finditer(run):
            yield m.start(), m.group(), "entropy_hex"


def entropy_spans(text: str, allow: list[re.Pattern]) -> list[tuple[int, int, int]]:
    found = []
    for m in _RUN.finditer(text):
        if any(p.fullmatch(m.group()) for p in allow):
            continue
        for at, run, kind in candidates(m.group()):
            digits = sum(map(str.isdigit, run))
            if (digits > 0) + any(map(str.islower, run)) + any(map(str.isupper, run)) < 2 or (run != m.group() and any(p.fullmatch(run) for p in allow)):
                continue
            if kind != "entropy_hex" and digits < MIN_DIGITS and not odd_parts(run):
                continue
            for a, b in hot_windows(run, THRESHOLDS[kind]):
                found.append((m.start() + at + a, KINDS.index(kind), m.start() + at + b))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. One pass, no shuffle."""
    C.ship(docs.sparkSession)
    base = C.texts(docs)
    schema = (f"doc_id {dict(base.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, "
              "base_sha256 string, spans string")

    def scan(batches):
        known = [re.compile(p) for p in allow]
        for b in batches:
            cols = [[] for _ in range(5)]
            for t in b.column(1).to_pylist():
                t = t.decode("utf-8", "replace") if t else ""
                spans = base_spans(t)
                for k in range(3):
                    cols[k].append(sum(s[1] == k for s in spans))
                cols[3].append(hashlib.sha256(_joined(spans).encode()).hexdigest())
                cols[4].append(_joined(spans + entropy_spans(t, known)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return base.mapInArrow(scan, schema)


def redact(text: str, allow: list[re.Pattern]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``[SECRET]``."""
    out, at = [], 0
    spans = sorted((a, b) for a, _, b in base_spans(text) + entropy_spans(text, allow))
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs``, all columns kept, secrets in ``text`` replaced and ``n_chars`` (if there) adjusted."""
    C.ship(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def scan(batches):
        known = [re.compile(p) for p in allow]
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t and redact(t, known) for t in old]
            out = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if size is not None:
                n = [c if x == y else len(y) for c, x, y in zip(b.column(size).to_pylist(), old, new, strict=True)]
                out = out.set_column(size, b.schema.field(size), pa.array(n, b.schema.field(size).type))
            yield out

    return docs.mapInArrow(scan, docs.schema)
