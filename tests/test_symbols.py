from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.operators import graph as G
from tessera.operators import search

JAVA = """
package a.b;
// public class Commented {}
/* public interface Hidden {} */
public class Outer extends Base {
    private List<Item> items;
    private Order order = null;
    public static final class Inner { }
    public interface Port { void send(Message m, int n); }
    class PackagePrivate { }
    public enum Color { RED }
    public record Point(int x, int y) { }
    void f(Customer c) { Invoice inv = make(); String s = "public class InString {}"; }
}
"""


def test_java_declared_symbols(spark):
    df = spark.createDataFrame([(JAVA,)], "t string")
    got = df.select(S.declared_symbols("t")).first()[0]
    assert got == ["Outer", "Inner", "Port"]


def test_java_used_symbols(spark):
    df = spark.createDataFrame([(JAVA,)], "t string")
    plain = set(df.select(S.used_symbols("t")).first()[0])
    assert {"Order", "Message", "Customer", "Invoice", "List<Item>"} <= plain
    assert "Item" not in plain                      # generic arguments do not resolve (default)
    with_args = set(df.select(S.used_symbols("t", with_type_args=True)).first()[0])
    assert {"Item", "List"} <= with_args


def test_java_used_symbols_leave_out_what_does_not_resolve(spark):
    text = "Foo[] a = x; a.b.Bar c = y; try { } catch (Baz e) { } catch (final Zap e) { } for (Qux q : qs) { } Real r = z;"
    got = spark.createDataFrame([(text,)], "t string").select(S.used_symbols("t")).first()[0]
    assert got == ["Real"]


def test_graph_nodes_include_edge_sources(spark):
    files = spark.createDataFrame([(1,), (2,)], "id bigint")
    edges = spark.createDataFrame([(9, 1), (2, 1)], "src bigint, dst bigint")
    assert sorted(r["id"] for r in G.graph_nodes(files, edges).collect()) == [1, 2, 9]


def test_search_result_records(spark):
    q = spark.createDataFrame([(1, 0, "alpha beta")], "q int, f int, t string")
    corpus = spark.createDataFrame([(10, "alpha beta", "r10"), (11, "alpha", "r11")], "id bigint, t string, rewrite string")
    hits = search.sparse_search(q, corpus, qid="q", fid="f", q_text="t", cid="id", c_text="t", distance=0.5, k=10)
    out = search.attach_records(hits, corpus, "id", ["t", "rewrite"]).orderBy("rank").collect()
    assert [(r["id"], r["rewrite"]) for r in out] == [(10, "r10"), (11, "r11")]
    assert abs(out[0]["distance"]) < 1e-12 and abs(out[1]["distance"] - (1 - 2 ** -0.5)) < 1e-12


LONG = 10_000_000


def _long_texts():
    """Literals and comments of ten million characters, closed and not, with names before and after them."""
    a, z = "public class Before { Item x = ", "; } public interface After { }"
    return {
        "string": a + '"' + "s" * LONG + '"' + z, "escapes": a + '"' + '\\"' * (LONG // 2) + '"' + z,
        "backslashes": a + '"' + "\\\\" * (LONG // 2) + '"' + z, "comment": a + "/*" + "* " * (LONG // 2) + "*/1" + z,
        "stars": a + "/*" + "*" * LONG + "/1" + z, "line": a + "1//" + "c" * LONG + "\n" + z,
        "text block": a + '"""' + 'x "" y' * (LONG // 6) + '"""' + z, "quotes": a + "1" + z + '"' * (LONG + 1),
        "open comment": a + "1" + z + "/*" + "c" * LONG, "generics": a + "1; " + "List<" * 100_000 + z}


def test_long_literals(spark):
    from tessera.functions.rules import dao_reason
    texts = _long_texts()
    df = spark.createDataFrame(list(texts.items()), "k string, t string").repartition(4)
    for r in df.select("k", S.declared_symbols("t").alias("d"), S.used_symbols("t").alias("u")).collect():
        assert r["d"] == ["Before", "After"] and "Item" in r["u"], r["k"]
    reasons = df.select("k", dao_reason(F.lit("src/A.java"), F.col("t")).alias("r"), F.length(S.strip_comments("t")).alias("n")).collect()
    assert {r["r"] for r in reasons} == {"none"}
    assert all(r["n"] < 100 for r in reasons if r["k"] not in ("quotes", "generics"))


def test_blanking_is_the_same_on_both_sides(spark):
    import random

    from tessera.functions import lexer
    r = random.Random(3)
    texts = ["".join(r.choice(['"', "'", "\\", "/", "*", "\n", "a", "A ", ";", '"""', "//", "/*", "*/"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {x["k"]: x["s"] for x in df.select("k", S.strip_comments("t").alias("s")).collect()}
    assert all(got[k] == lexer.blank(t) for k, t in enumerate(texts))


def test_nested_generics_and_literals(spark):
    text = """
    public final class Übung<T> { Map<String, List<Map<Key, Value[]>>> all; String s = \"\"\"
      public class InBlock { Hidden h; } \"\"\"; char c = '"'; Real r = '\\''; /* Gone g; */ boolean b = Low < High && x > y;
      void f(final Param<?> p, Other... rest) { for (Each e : all) { } } }
    public static non-sealed abstract class Second { } public @interface Note { } public enum E { }
    """
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = df.select(S.declared_symbols("t").alias("d"), S.used_symbols("t").alias("u"), S.used_symbols("t", with_type_args=True).alias("a")).collect()
    assert rows[0]["d"] == ["Übung", "Second"]
    assert rows[0]["u"] == ["Map<String, List<Map<Key, Value[]>>>", "String", "Real", "Param<?>"]
    assert set(rows[0]["a"]) - set(rows[0]["u"]) == {"Map", "List", "Key", "Value", "Param"}
    assert rows[1]["d"] is None and rows[2]["d"] == [] and rows[2]["u"] == []
