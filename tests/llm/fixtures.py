"""Small inputs with every awkward case, shared by the operator tests."""

import random

SF = "/root/testdata/sf0.01"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}é" if r.random() < 0.2 else f"W{r.randrange(size)}" for _ in range(n)]


def edge_rows():
    """(doc_id, text): null id, null and empty texts, white space, a long word, repeats, near copies."""
    a = words(300, 1)
    b = a[:150] + ["Changed"] + a[151:]
    passage = words(60, 2)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "x" * 5000), (None, " ".join(a)), (None, None),
        (7, " ".join(a)), (8, " ".join(a)), (8, " ".join(a)), (9, " ".join(b)), (10, "  ".join(a) + "\n"),
        (11, " ".join(words(40, 3) + passage + words(40, 4))), (12, " ".join(passage + words(90, 5))),
        (13, " ".join(words(10, 6) + passage[:25])), (14, "ab " * 3000), (15, " ".join(["z"] * 40)), (16, "One Two"),
        (17, " ".join(words(20_000, 8, 3000))), (18, "a\x0bb\x0cc\x1cd e f"), (19, " ".join(passage[:19])), (20, " ".join(passage[:20])),
        (12, "another text of the same id"),
    ]
    for k in range(40):  # a chain of near copies, each a few words from the one before
        c = list(a)
        for j in range(k):
            c[7 * j % 300] = f"v{j}"
        rows.append((100 + k, " ".join(c)))
    return rows


SCHEMA = "doc_id long, text string, text_hash long, class string, word string, grp int, open boolean, payload string, n_chars long"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with inner ones."""
    full = [(i, t, 5, "c", "w", 1, True, "p", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
