"""One function per named query: (spark, sf_dir) -> DataFrame over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..sources.tables import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _doc_lines(spark, sf_dir) -> DataFrame:
    """Non-blank lines of every document (COL-4 with the ``\\n`` delimiter), 0-based."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(T.fragments("text", "\n")).alias("line_no", "line"))


def sparse_topk_at(spark, sf_dir, distance=0.5, k=10) -> DataFrame:
    lines = _doc_lines(spark, sf_dir)
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = search.sparse_search(lines, bench, qid="doc_id", fid="line_no", q_text="line",
                                cid="item_id", c_text="text", distance=distance, k=k)
    return hits.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each document (its lines as fragments) -> best benchmark items."""
    return sparse_topk_at(spark, sf_dir, distance=0.5, k=10)


# ---------------------------------------------------------------- scans and text columns
from ..functions import jsontext as J  # noqa: E402
from ..functions import rules as R  # noqa: E402
from ..operators.common import batch_number, dense_index  # noqa: E402
from ..sources import corpus  # noqa: E402

# Binding parameters for the pages table (URLs stand in for file paths).
PAGE_SUFFIXES = (".html",)
PAGE_PRUNE = (".", "test", "target", "build", "ads-", "m.")


def page_relpath(url_col="url"):
    """host/path of a URL: scheme, query and fragment removed."""
    return F.regexp_replace(F.regexp_replace(F.col(url_col), "^[a-z]+://", ""), "[?#].*$", "")


@query
def corpus_scan(spark, sf_dir):
    """SRC-1/SRC-2: suffix any-of and directory-prefix pruning over URL paths."""
    p = table(spark, sf_dir, "pages").select("page_id", page_relpath().alias("path"))
    kept = p.where(corpus.has_suffix("path", PAGE_SUFFIXES) & ~corpus.pruned("path", PAGE_PRUNE))
    return kept.select("page_id", "path", F.size(F.split("path", "/")).alias("depth"),
                       T.base_name("path").alias("name"))


@query
def line_count(spark, sf_dir):
    """COL-1 / SRC-3."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.line_count("text").alias("line_count"))


def _java_sources(spark, sf_dir) -> DataFrame:
    """One Java (or XML) source per order: (id, path, content). The key's residue picks the kind of class."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    v = F.pmod("o_orderkey", F.lit(9))
    plain = F.concat(F.lit("public class Order"), k)
    head = F.when(v == 2, F.concat(F.lit("public class OrderRepository"), k)).when(v == 3, F.concat(plain, F.lit(" extends BaseMapper"))).otherwise(plain)
    body = (F.when(v == 4, F.lit("void f() { org.hibernate.Session.open(); }"))
            .when(v == 5, F.lit("Object f() { return preparedStatement; }"))
            .when(v == 6, F.lit("void f() throws IOException, SQLException { }"))
            .when(v == 7, F.lit('String s = "class FooDao throws SQLException";')).otherwise(F.lit("")))
    members = F.concat(F.lit(" private Map<Cust"), c, F.lit(", List<Line>> items; void g(Cust"), c, F.lit(" x, final Area"), F.pmod("o_custkey", F.lit(25)).cast("string"),
                       F.lit(" y) { Gone[] a; try { } catch (Lost e) { } Part"), k, F.lit(" z = null; }"))
    port = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit(" public interface Port"), k, F.lit(" { }"))).otherwise(F.lit(""))
    content = F.concat(F.lit("package app;\n/* public class OrderDao"), k, F.lit(" { Hidden h; } */ // calls getConnection\n"), head, F.lit(" { "), body, members, port, F.lit(" }\n"))
    folder = F.when(v == 1, F.lit("src/dao/Order")).otherwise(F.lit("src/app/Order"))
    path = F.concat(folder, k, F.when(v == 0, F.lit(".xml")).otherwise(F.lit(".java")))
    return o.select(F.col("o_orderkey").alias("id"), path.alias("path"), content.alias("content"))


@query
def rule_classify(spark, sf_dir):
    """COL-2 over one source file per order; every rule decides some of them."""
    src = _java_sources(spark, sf_dir)
    return src.select("id", R.dao_reason("path", "content").alias("reason")).withColumn("is_dao", R.is_dao("reason"))


@query
def java_symbols(spark, sf_dir):
    """COL-16 / COL-17 with the Java lexer over the same files: declared types, used types, and these with type arguments."""
    src = _java_sources(spark, sf_dir)
    return src.select("id", F.array_join(S.declared_symbols("content"), ",").alias("declared"), F.array_join(S.used_symbols("content"), ";").alias("used"),
                      F.array_join(F.array_sort(S.used_symbols("content", with_type_args=True)), ";").alias("used_args"))


@query
def code_normalise(spark, sf_dir):
    """COL-3 / WIN-4 over page HTML: one row per output line with its nesting level."""
    from ..operators.textops import normalise_code_lines
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return normalise_code_lines(p, "page_id", "html")


@query
def fragments(spark, sf_dir):
    """COL-4 with the newline delimiter (the documents hold no blank-line breaks)."""
    return _doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("pos"),
                                            F.col("line").alias("fragment"))


def _json_variant():
    """events.props rewritten into the answer shapes a model returns."""
    p = F.col("props")
    v = F.pmod(F.col("event_id"), F.lit(6))
    return (F.when(v == 0, p)
            .when(v == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(v == 2, F.concat(F.lit("["), p, F.lit("]")))
            .when(v == 3, F.lit("  \n "))
            .when(v == 4, F.lit("```json\n\n```"))
            .otherwise(F.concat(p, F.lit("}"))))     # trailing brace: not valid JSON


@query
def json_status(spark, sf_dir):
    """COL-5: normalise answers and classify them (ok / empty / not_object / invalid)."""
    e = table(spark, sf_dir, "events").select("event_id", _json_variant().alias("answer"))
    st = J.response_status("answer")
    body = J.response_body("answer")
    return e.select("event_id", st.alias("status"),
                    F.when(st == "ok", body).alias("body"),
                    F.when(st == "ok", F.get_json_object(body, "$.k").cast("bigint")).alias("k"))


def _marked():
    t = F.col("text")
    v = F.pmod(F.col("turn"), F.lit(4))
    return (F.when(v == 0, F.concat(F.lit("DELIMITER_CODE_START@"), t, F.lit("@DELIMITER_CODE_END")))
            .when(v == 1, F.concat(F.lit("DELIMITER_CODE_START"), t, F.lit("DELIMITER_CODE_END")))
            .when(v == 2, F.concat(F.lit("DELIMITER_CODE_START@DELIMITER_CODE_START"), t))
            .otherwise(t))


@query
def prune_delims(spark, sf_dir):
    """COL-6 on scalars and on every element of an array."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", _marked().alias("m"))
    return c.select("conv_id", "turn", T.prune_code_delimiters("m").alias("pruned"),
                    F.array_join(T.prune_code_delimiters_array(F.split("m", "\n")), "|").alias("pruned_lines"))


@query
def row_json(spark, sf_dir):
    """COL-7: customer rows as JSON without the excluded keys."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", J.row_json(c, exclude=("c_acctbal", "c_mktsegment")).alias("json"))


def _line_answer():
    k = F.get_json_object("props", "$.k")
    v = F.pmod(F.col("event_id"), F.lit(4))
    return (F.when(v == 0, F.concat(F.lit('{"start_line": "'), k, F.lit('"}')))
            .when(v == 1, F.concat(F.lit('{"start_line": '), k, F.lit("}")))
            .when(v == 2, F.lit("{}"))
            .otherwise(F.concat(F.lit('{"start_line": "'), k, F.lit('a"}'))))


@query
def default_cast(spark, sf_dir):
    """COL-8: missing -> -1, numeric -> int, other text -> null plus quarantine column."""
    e = table(spark, sf_dir, "events").select("event_id", _line_answer().alias("a"))
    raw = F.get_json_object("a", "$.start_line")
    return e.select("event_id", J.int_or_default(raw).alias("start_line"),
                    J.quarantine(raw).alias("bad_start_line"))


@query
def basename(spark, sf_dir):
    """COL-9."""
    return table(spark, sf_dir, "pages").select("page_id", T.base_name("url").alias("name"))


@query
def dense_id_batches(spark, sf_dir):
    """COL-10 / COL-11: dense 0-based id over (o_custkey, o_orderkey), batches of 100."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ix = dense_index(o, ["o_custkey", "o_orderkey"], index_col="idx")
    return ix.select("o_orderkey", "o_custkey", "idx", batch_number("idx", 100).alias("batch"))


# ---------------------------------------------------------------- reference graph
from ..functions import symbols as S  # noqa: E402
from ..operators import graph as G  # noqa: E402

# Binding parameters: documents declare the capitalised words at their lines' starts and use all of them.
WORD_SYMBOL = "[A-Z][a-z]{3,}"
LINE_SYMBOL = r"(?:^|\n)([A-Z][a-z]{3,})"


def _declares(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = F.array_distinct(S.declared_symbols("text", LINE_SYMBOL, strip=False))
    return d.select(F.col("doc_id").alias("path"), F.explode(found).alias("symbol"))


def _uses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    used = S.used_symbols("text", WORD_SYMBOL, group=0, strip=False)
    return d.select(F.col("doc_id").alias("path"), F.explode(used).alias("symbol"))


def _edges(spark, sf_dir):
    return G.reference_edges(_uses(spark, sf_dir), G.symbol_owner(_declares(spark, sf_dir)))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def _relaxed(spark, sf_dir):
    return G.relax_cycles(_nodes(spark, sf_dir), _edges(spark, sf_dir))[0]


def _levels(spark, sf_dir):
    return G.dependency_levels(_nodes(spark, sf_dir), _relaxed(spark, sf_dir))


@query
def declares(spark, sf_dir):
    """COL-16 + AGG-2: declared symbols per document, documents without any included."""
    files = _nodes(spark, sf_dir).withColumnRenamed("id", "path")
    per = G.symbols_per_file(files, _declares(spark, sf_dir))
    return per.select(F.col("path").alias("doc_id"), F.array_join("symbols", ",").alias("symbols"),
                      F.size("symbols").alias("n_symbols"))


@query
def uses(spark, sf_dir):
    """COL-17: distinct used symbols per document."""
    return _uses(spark, sf_dir).select(F.col("path").alias("doc_id"), "symbol")


@query
def symbol_owner(spark, sf_dir):
    """AGG-1: owner per symbol, greatest declaring id wins."""
    return G.symbol_owner(_declares(spark, sf_dir)).select("symbol", F.col("path").alias("doc_id"))


@query
def reference_edges(spark, sf_dir):
    """JOIN-1 / GRF-1."""
    return _edges(spark, sf_dir)


@query
def relaxed_edges(spark, sf_dir):
    """GRF-2 / SET-3: edges left after removing src < dst edges inside each SCC."""
    return _relaxed(spark, sf_dir)


@query
def dep_levels(spark, sf_dir):
    """GRF-3 / GRF-4."""
    return _levels(spark, sf_dir)


@query
def level_sizes(spark, sf_dir):
    """AGG-11."""
    return G.level_sizes(_levels(spark, sf_dir))


@query
def components(spark, sf_dir):
    """GRF-6 over the unrelaxed edges."""
    return G.weak_components(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query
def successor_changes(spark, sf_dir):
    """JOIN-7 / GRF-7: per node, its direct successors and how many of them carry a change
    (a document with a ``labels`` row of quality 1). The changes stay flattened (one row per
    edge upstream); per node only aggregates are kept, so a hub never becomes one list."""
    e = _relaxed(spark, sf_dir)
    changed = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("dst"),
                                                                         F.lit(1).alias("c"))
    j = e.join(changed, "dst", "left")
    return j.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("n_successors"),
        F.count("c").alias("n_changed"),
        F.min(F.when(F.col("c") == 1, F.col("dst"))).alias("first_changed"),
        F.max(F.when(F.col("c") == 1, F.col("dst"))).alias("last_changed"))


@query
def level_propagation(spark, sf_dir):
    """GRF-5: nodes are processed level by level over the relaxed DAG; a node is marked
    changed when it carries its own change (``labels`` quality 1) or a direct successor
    was marked at an earlier level, so results flow upward through the schedule."""
    dag = _relaxed(spark, sf_dir)
    levels = G.dependency_levels(_nodes(spark, sf_dir), dag)
    own = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"),
                                                                     F.lit(True).alias("own"))

    def node_fn(f, child):
        if child is None:  # no edge leaves the level
            return f.select("id", F.coalesce("own", F.lit(False)).alias("changed"))
        c = child.groupBy("id").agg(F.max(F.col("changed").cast("int")).alias("_c"))
        return f.join(c, "id", "left").select(
            "id", (F.coalesce("own", F.lit(False)) | (F.coalesce("_c", F.lit(0)) == 1)).alias("changed"))

    res = G.propagate_by_level(levels.join(own, "id", "left"), dag, node_fn)  # labels are read once, not once a level
    return res.join(levels, "id").select("id", "level", "changed")


# ---------------------------------------------------------------- vectors and embeddings
from ..functions import vectors as V  # noqa: E402
from ..operators import embed as EM  # noqa: E402
from ..operators.common import bounded_broadcast  # noqa: E402

# Binding parameters: dense search on random unit vectors needs a wide distance.
DENSE_DISTANCE = 0.75
# Evaluation thresholds of the pair-cosine binding (code, description).
CODE_THRESHOLD, DESC_THRESHOLD = 0.65, 0.0


def _weights_checksum(vec):
    """sum((i+1) * v_i), rounded: a compact, order-sensitive fingerprint of a vector."""
    s = F.aggregate(F.zip_with(V.as_double(vec), F.sequence(F.lit(1), F.size(vec)),
                               lambda x, i: x * i.cast("double")),
                    F.lit(0.0), lambda a, x: a + x)
    return F.round(s, 6)


@query
def unembedded(spark, sf_dir):
    """SET-1 / SET-2 / JOIN-2: benchmark and document texts without a stored vector
    (documents with a ``labels`` row count as already embedded)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = (docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
              .select(EM.text_key("text").alias("key")))
    corpus = (table(spark, sf_dir, "benchmark").select(F.col("text").alias("example"))
              .unionByName(docs.select(F.col("text").alias("example"))))
    miss = EM.unembedded_strings(corpus, stored, string_cols=("example",))
    return miss.select(F.col("key").alias("text_sha"), F.length("text").alias("n_chars"))


# Fixed value of the binding: the rewrite of a record is its text plus this marker line.
REWRITE_MARK = "\n-- rewritten"


@query
def corpus_upsert(spark, sf_dir):
    """VEC-5 / JOIN-3 / JOIN-4: benchmark (new corpus) refreshed over a stored corpus built
    from documents (old version); example = whole text, rewrite = text plus a marker line;
    vectors are the letter profile."""
    new = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("example"),
        F.concat("text", F.lit(REWRITE_MARK)).alias("rewrite"))
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("example"),
        F.concat("text", F.lit(REWRITE_MARK)).alias("rewrite"))
    old = V.with_letter_profile(old, "example", "example_embedding")
    old = V.with_letter_profile(old, "rewrite", "rewrite_embedding")
    out = EM.refresh_corpus(new, old)
    return out.select("id", F.sha2("example", 256).alias("example_sha"), F.length("rewrite").alias("rewrite_chars"),
                      _weights_checksum("example_embedding").alias("example_checksum"),
                      _weights_checksum("rewrite_embedding").alias("rewrite_checksum"))


@query
def id_integrity(spark, sf_dir):
    """AGG-10: duplicated (and missing) ids."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return li.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull())


def _pairs(spark, sf_dir):
    """JOIN-8: case k is vector k, answer k is vector k+1 (every vector plays both roles),
    joined on the carried k, never on row order. The last case has no answer."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cases = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("a"))
    answers = e.select((F.col("vec_id") - 1).alias("k"), F.col("embedding").alias("b"))
    return cases, answers


@query
def pair_cosine(spark, sf_dir):
    """VEC-2 / JOIN-8."""
    cases, answers = _pairs(spark, sf_dir)
    j = cases.join(answers, "k")
    return j.select(F.col("k").alias("pair_id"), F.round(V.cosine("a", "b"), 6).alias("cosine"))


@query
def accuracy(spark, sf_dir):
    """AGG-9 / COL-18: share of cases whose two similarities pass both thresholds, in percent;
    the denominator is every case, answered or not."""
    cases, answers = _pairs(spark, sf_dir)
    j = cases.join(answers, "k", "left")
    code = V.cosine(V.abs_vector("a"), V.abs_vector("b"))
    desc = V.cosine("a", "b")
    ok = F.when(F.col("b").isNotNull() & (code >= CODE_THRESHOLD) & (desc >= DESC_THRESHOLD), 1).otherwise(0)
    return j.agg(F.count(F.lit(1)).alias("n_cases"), F.sum(ok).alias("n_correct"),
                 F.round(T.percent(F.coalesce(F.avg(ok), F.lit(0.0))), 6).alias("accuracy_pct"))


@query
def dense_topk(spark, sf_dir):
    """VEC-4 / JOIN-5 / AGG-3 / WIN-1 on dense vectors: one query per label with two fragments, the
    label's centroid and its vector of the smallest id, searched against every vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    cent = EM.mean_pool(e, ["label"], "embedding", out="v").withColumn("frag", F.lit(0))
    first = (e.groupBy("label").agg(F.min_by(V.as_double("embedding"), "vec_id").alias("v"))
             .withColumn("frag", F.lit(1)))
    hits = search.dense_search(cent.unionByName(first), e, qid="label", fid="frag", q_vec="v", cid="vec_id",
                               c_vec="embedding", distance=DENSE_DISTANCE, k=10)
    return hits.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def truncate_pool(spark, sf_dir):
    """COL-15 / VEC-3 / AGG-12: first 64 tokens of each document, a token's vector is the
    ``embeddings`` row whose id is the token length, mean-pooled per dimension."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    toks = d.select("doc_id", F.explode(T.truncate(T.word_tokens("text"), 64)).alias("tok"))
    by_len = toks.groupBy("doc_id", F.length("tok").cast("bigint").alias("vec_id")).agg(
        F.count(F.lit(1)).cast("double").alias("cnt"))
    # only vectors of occurring token lengths are needed: a handful of rows, whatever the
    # size of the vector table; broadcast after the count proves it small
    lengths = by_len.select("vec_id").distinct()
    emb = (table(spark, sf_dir, "embeddings").select("vec_id", V.as_double("embedding").alias("v"))
           .join(lengths, "vec_id", "left_semi"))
    emb, _ = bounded_broadcast(emb, 100_000)   # 64 doubles a row: <= ~60 MB
    j = by_len.join(emb, "vec_id")
    dims = F.size(F.col("v"))
    per = j.groupBy("doc_id").agg(
        F.collect_list(F.struct("cnt", "v")).alias("_l"), F.sum("cnt").alias("_n"), F.max(dims).alias("_d"))
    pooled = per.select("doc_id", F.aggregate(
        "_l", F.array_repeat(F.lit(0.0), F.col("_d")),
        lambda acc, x: V.add(acc, V.scale(x["v"], x["cnt"]))).alias("_s"), "_n")
    pooled = pooled.select("doc_id", F.transform("_s", lambda x: x / F.col("_n")).alias("p"))
    return pooled.select("doc_id", F.posexplode("p").alias("dim", "value")).select(
        "doc_id", "dim", F.round("value", 6).alias("value"))


@query
def embed_batch(spark, sf_dir):
    """VEC-1 through the batch hook with the default hashed term vectors."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    e = EM.embed_texts(b, "text")
    return e.select("item_id", F.size("embedding").alias("n_dims"),
                    F.size(F.filter("embedding", lambda x: x != 0)).alias("n_nonzero"),
                    _weights_checksum("embedding").alias("embedding_checksum"))


# ---------------------------------------------------------------- extraction over recorded answers
from ..operators import extract as X  # noqa: E402

# Flag -> complexity and priority -> effort of the bindings; the effort order.
COMPLEXITY_OF_FLAG = {"A": "SIMPLE", "N": "MODERATE", "R": "COMPLEX"}
EFFORT_OF_PRIORITY = {"1-URGENT": "Major", "2-HIGH": "Moderate", "3-MEDIUM": "Minor"}
EFFORT_RANK = {"Major": 1, "Moderate": 2, "Minor": 3}


def _map(col, mapping, default=None):
    e = None
    for k, v in mapping.items():
        e = (F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v)))
    return e.otherwise(default if default is not None else F.lit(None))


def _complexity():
    return _map(F.col("l_returnflag"), COMPLEXITY_OF_FLAG, F.lit("COMPLEX"))


@query
def context_block(spark, sf_dir):
    """COL-12 / COL-13 / COL-14 / WIN-5: user turns are questions (numbered 1.. per
    conversation), the next assistant turn's non-blank lines are their results."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = conv.where(F.col("role") == "user")
    q = dense_index(users.select("conv_id", "turn", "text"), ["turn"], ["conv_id"], index_col="_i")
    q = q.select("conv_id", "turn", (F.col("_i") + 1).alias("q_no"), F.col("text").alias("question"))
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"),
        F.posexplode(T.fragments("text", "\n")).alias("_p", "result"))
    hits = (asst.join(q.select("conv_id", "turn", "q_no"), ["conv_id", "turn"])
            .select("conv_id", "q_no", (F.col("_p") + 1).alias("r_no"), "result"))
    blk = X.context_block(q, hits, "conv_id")
    prompt = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return blk.select("conv_id", "n_questions", "n_answered",
                      X.extend_prompt(prompt, F.col("block"), F.col("n_answered")).alias("prompt"))


# Fixed values of the binding: the schemas that the full route shows.
OLD_SCHEMA = "CREATE TABLE orders (id INT AUTO_INCREMENT)"
NEW_SCHEMA = "CREATE TABLE orders (id INT64)"


@query
def prompt_replay(spark, sf_dir):
    """INF-1 / INF-2: one prompt per source file, routed by the classifier; recorded answers (assistant turns of the
    conversation with the same id) attached by key. Of the prompt only its length and hash go through the join."""
    src = _java_sources(spark, sf_dir).select(F.col("id").alias("prompt_key"), "path", "content",
                                              R.is_dao(R.dao_reason("path", "content")).alias("is_dao"))
    prompts = X.route_prompts(src, OLD_SCHEMA, NEW_SCHEMA).select("prompt_key", "route", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("sha"))
    resp = (table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("prompt_key"), F.col("turn").alias("attempt"), "text"))
    j = X.attach_responses(prompts, resp, "prompt_key")
    return j.groupBy("prompt_key", "route").agg(
        F.max("chars").alias("prompt_chars"), F.max("sha").alias("prompt_sha"), F.count("text").alias("n_responses"),
        F.min("attempt").alias("first_attempt"))


def _part_answers(spark, sf_dir):
    """One model answer per part: a change whose description names the part, and a question about it."""
    p = table(spark, sf_dir, "part")
    about = F.concat(F.lit("part "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    change = F.concat(F.lit('{"file_modifications": [{"code_sample": "P'), F.col("p_partkey").cast("string"), F.lit('", "start_line": '), F.col("p_size").cast("string"),
                      F.lit(', "description": "'), about, F.lit('", "complexity": "SIMPLE"}, {"description": "nothing known of it"}, {}]}'))
    question = F.concat(F.lit('{"questions": ["'), about, F.lit('?", "unheard of?"]}'))
    return p.select("p_partkey", change.alias("value"), question.alias("questions"))


def _part_records(spark, sf_dir):
    """Retrieval records: one per name and type of parts."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    about = F.concat(F.lit("part "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    return p.select("id", about.alias("example"), F.concat(F.lit("use part "), F.col("id").cast("string")).alias("rewrite"))


@query
def notes_enrich(spark, sf_dir):
    """INF-4 with JOIN-10: change rows get the rewrites of the ten nearest records of their description as notes."""
    changes = X.explode_changes(_part_answers(spark, sf_dir), "p_partkey")
    noted = X.attach_hits(changes, _part_records(spark, sf_dir), "description", "notes", k=10)
    return noted.select("p_partkey", "pos", "description", "start_line", F.array_join("notes", "|").alias("notes"), F.size("notes").alias("n_notes"))


@query
def question_answers(spark, sf_dir):
    """INF-6 with JOIN-11: every question gets its two nearest records."""
    asked = X.explode_questions(_part_answers(spark, sf_dir).select("p_partkey", F.col("questions").alias("value")), "p_partkey")
    found = X.attach_hits(asked, _part_records(spark, sf_dir), "question", "answers", k=2)
    return found.select("p_partkey", "pos", F.array_join("answers", "|").alias("answers"), F.size("answers").alias("n_answers"))


def _attempt_text():
    t = F.col("text")
    v = F.pmod(F.length(t), F.lit(4))
    return (F.when(v == 0, F.lit(""))
            .when(v == 1, F.concat(F.lit('```json\n{"turn": '), F.col("turn").cast("string"), F.lit("}\n```")))
            .when(v == 2, F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
            .otherwise(t))


@query
def attempt_resolution(spark, sf_dir):
    """INF-3: conversation turns are attempts; the first object-or-empty answer among the
    first three wins."""
    a = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("attempt"), _attempt_text().alias("text"))
    return X.resolve_attempts(a, "conv_id", max_attempts=3)


def _order_answers(spark, sf_dir):
    """One JSON answer per order built from its line items (the shape of a file analysis)."""
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber").cast("string")
    start = (F.when(F.col("l_returnflag") == "N", F.lit(""))
             .when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), F.lit('"start_line": "x1", '))
             .otherwise(F.concat(F.lit('"start_line": "'), (F.col("l_linenumber") * 10).cast("string"), F.lit('", '))))
    obj = F.concat(
        F.lit('{"code_sample": "L'), ln, F.lit('", '), start,
        F.lit('"end_line": '), F.when(F.col("l_linenumber") == 3, F.lit('"9z"')).otherwise(
            (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("string")),
        F.lit(', "suggested_change": "use part '), F.col("l_partkey").cast("string"),
        F.lit('", "description": "supplier '), F.col("l_suppkey").cast("string"),
        F.lit('", "complexity": "'), _complexity(),
        F.lit('", "warnings": ['), F.when(F.col("l_discount") >= 0.05, F.lit('"discount"')).otherwise(F.lit("")),
        F.lit("]}"))
    sig = F.when(F.col("l_linestatus") == "F", F.concat(
        F.lit('{"original_signature": "f'), ln, F.lit('(int)", "new_signature": "f'), ln,
        F.lit('(long)", "explanation": "supplier '), F.col("l_suppkey").cast("string"), F.lit('"}')))
    qst = F.when(F.col("l_discount") >= 0.05, F.concat(F.lit('"part '), F.col("l_partkey").cast("string"), F.lit('?"')))
    g = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", obj.alias("o")))).alias("_o"),
        F.array_sort(F.collect_list(F.when(sig.isNotNull(), F.struct("l_linenumber", sig.alias("s"))))).alias("_s"),
        F.array_sort(F.collect_list(F.when(qst.isNotNull(), F.struct("l_linenumber", qst.alias("q"))))).alias("_q"))
    file_answer = F.concat(
        F.lit('{"file_modifications": ['), F.array_join(F.transform("_o", lambda x: x["o"]), ", "),
        F.lit('], "method_signature_changes": ['), F.array_join(F.transform("_s", lambda x: x["s"]), ", "),
        F.lit("]}"))
    q_answer = F.when(F.size("_q") > 0, F.concat(
        F.lit('{"questions": ['), F.array_join(F.transform("_q", lambda x: x["q"]), ", "), F.lit("]}"))) \
        .otherwise(F.lit("{}"))
    return g.select("l_orderkey", file_answer.alias("value"), q_answer.alias("questions"))


@query
def explode_changes(spark, sf_dir):
    """INF-4 / SET-4 with COL-8 defaults."""
    ch = X.explode_changes(_order_answers(spark, sf_dir), "l_orderkey")
    return ch.withColumn("warnings", F.array_join("warnings", ","))


@query
def explode_signatures(spark, sf_dir):
    """INF-5."""
    return X.explode_signatures(_order_answers(spark, sf_dir), "l_orderkey")


@query
def explode_questions(spark, sf_dir):
    """INF-6 (null-safe)."""
    a = _order_answers(spark, sf_dir).select("l_orderkey", F.col("questions").alias("value"))
    return X.explode_questions(a, "l_orderkey")


# ---------------------------------------------------------------- report aggregates
from ..operators import report as RP  # noqa: E402


def _changes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("filename"), "l_linenumber", _complexity().alias("complexity"), "l_quantity")


@query
def complexity_matrix(spark, sf_dir):
    """AGG-4: changes per file and complexity."""
    return RP.complexity_matrix(_changes(spark, sf_dir), "filename")


@query
def complexity_values(spark, sf_dir):
    """AGG-13."""
    return _changes(spark, sf_dir).select("complexity").distinct()


@query
def lines_by_complexity(spark, sf_dir):
    """AGG-5: sum of integer line counts per complexity (counts arrive as text)."""
    t = _changes(spark, sf_dir).select("complexity", F.col("l_quantity").cast("int").cast("string").alias("numberOfLines"))
    return RP.lines_by_complexity(t)


@query
def tasks_by_effort(spark, sf_dir):
    """AGG-6 / WIN-2 / WIN-3: tasks stably sorted by effort rank, grouped by effort."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    effort = _map(F.col("o_orderpriority"), EFFORT_OF_PRIORITY, F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    t = o.select("o_orderkey", effort.alias("effort"))   # the lowest priority stands for a missing effort
    return RP.tasks_by_effort(t, "o_orderkey", EFFORT_RANK)


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filename"), T.line_count("text").alias("line_count"))
    impacted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filename"))
    return d, impacted


@query
def app_totals(spark, sf_dir):
    """AGG-7."""
    return RP.app_totals(*_files(spark, sf_dir))


@query
def impact_split(spark, sf_dir):
    """AGG-8."""
    return RP.impact_split(*_files(spark, sf_dir))


@query
def task_changes(spark, sf_dir):
    """JOIN-6: every order is a task whose indexes are line numbers 1..7; matching line
    items are attached and re-nested in index order."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"),
                                                  F.sequence(F.lit(1), F.lit(7)).alias("indexes"))
    ch = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"),
                                                 F.col("l_linenumber").alias("idx"), "l_quantity")
    return RP.task_changes(tasks, ch, "task", "l_quantity", "total_qty")


@query
def affected_changes(spark, sf_dir):
    """JOIN-9: changes of affected files (orders with status F) by file and complexity."""
    affected = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("filename"))
    return RP.affected_changes(_changes(spark, sf_dir), affected)


@query
def example_block(spark, sf_dir):
    """COL-13: every document's content is searched (distance 0.5, top 10) against the
    benchmark items, whose hits are formatted as rewrite examples in rank order. Fragments
    are lines (the documents hold no blank-line breaks)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = d.select("doc_id", F.posexplode(T.fragments("text", "\n")).alias("frag", "ftext"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = search.sparse_search(q, bench, qid="doc_id", fid="frag", q_text="ftext", cid="item_id",
                                c_text="text", distance=0.5, k=10)
    recs = bench.select("item_id", F.col("text").alias("example"),
                        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("rewrite"))
    hits = hits.join(recs, "item_id").select("doc_id", "rank", "example", "rewrite")
    return X.example_block(d, hits, "doc_id")
