"""COL-2: ordered rule classifier for data-access source files.

The rules are evaluated in a fixed order inside one ``CASE WHEN``; the first rule
that fires gives the ``reason``. Everything is a JVM regular expression over the
file text, so a corpus of any size is classified in one scan with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import strip_comments

# Keyword lists of the classifier.
DAO_NAME_KEYWORDS = ["Dao", "Repository", "Persistence", "Mapper"]
DAO_ANNOTATIONS = ["@Repository", "@Service", "@Component", "@Mapper"]
DAO_LIBRARIES = ["javax.persistence", "org.springframework.data", "org.hibernate"]
JDBC_KEYWORDS = ["Connection", "Statement", "PreparedStatement", "ResultSet", "DriverManager"]


def _alt(words, escape=False):
    return "|".join(w.replace(".", r"\.") if escape else w for w in words)


_NAMES = _alt(w.lower() for w in DAO_NAME_KEYWORDS)
# Patterns are written so Java regex and RE2 read them the same way.
RULES = [
    ("class_name", rf"(?i)\bclass\s+\w*({_NAMES})"),
    ("annotation", rf"@({_alt(a[1:] for a in DAO_ANNOTATIONS)})\b"),
    ("superclass", rf"(?i)\bextends\s+[\w.]*({_NAMES})"),
    ("library_call", rf"({_alt(DAO_LIBRARIES, escape=True)})[\w.]*\.\w+\s*\("),
    # a name, not a call: no opening parenthesis after it (written without look-ahead)
    ("jdbc_member", rf"\b[a-z_]\w*(?:{_alt(JDBC_KEYWORDS)})\w*(?:\s+\w|\s*(?:[^\w\s(]|$))"),
    ("throws_sql", r"\bthrows\s+[\w.,\s]*SQLException"),
]


def dao_reason(path, content, suffix: str = ".java", match_annotations: bool = False) -> Column:
    """Return the first rule that marks the file as data-access code, or ``'none'``; comments and
    string literals are blanked before the content rules.

    Order: suffix gate, ``dao`` anywhere in the path (any case), class name, annotation
    (off by default: the original compares case-folded names with a mixed-case list and
    never matches), superclass, persistence-library call, JDBC member, ``throws SQLException``.
    """
    p = F.col(path) if isinstance(path, str) else path
    c = strip_comments(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")))
    expr = F.when(~p.endswith(suffix), F.lit("not_source")).when(
        F.lower(p).contains("dao"), F.lit("path"))
    for name, pattern in RULES:
        if name == "annotation" and not match_annotations:
            continue
        expr = expr.when(c.rlike(pattern), F.lit(name))
    return expr.otherwise(F.lit("none"))


def is_dao(reason_col) -> Column:
    r = F.col(reason_col) if isinstance(reason_col, str) else reason_col
    return ~r.isin("none", "not_source")
