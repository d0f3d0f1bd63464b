"""Documents, retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granum import storage
from granum.functions import html as H
from granum.functions import text as X
from granum.operators import documents as D
from granum.operators import evaluation as E
from granum.operators import search as R
from granum.operators import text_index as L
from granum.operators import vector_index as V
from granum.operators import table_functions as TF
from granum.plans.registry import query
from granum.plans.textual import _CLEAN, _COLLAPSE, _unescape_sql, docs
from granum.sources.tables import parquet
from granum.streaming import windows as W

_STRIP = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_HTML = _COLLAPSE(_unescape_sql(f"regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')"))


@query("html_to_text", f"SELECT page_id, {_HTML} AS body FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    return parquet(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query("html_visible", f"SELECT page_id, {_HTML} AS body FROM pages")
def html_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text by the tokenizer that takes broken pages too; on well-formed ones both agree."""
    return parquet(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("body"))


@query("section_split")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of filings made of five documents each under item headings."""
    part = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 5).alias("filing_id"), (F.col("doc_id") % 5).alias("k"), "text")
    items = F.array(*map(F.lit, ["1", "1A", "3", "7", "8"]))
    headed = part.withColumn("piece", F.concat(F.lit("Item "), F.element_at(items, (F.col("k") + 1).cast("int")), F.lit(". "), F.col("text")))
    whole = headed.groupBy("filing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
    return D.section_split(whole, "filing_id", "text").select("filing_id", "item", "start", "stop", "parsed_by")


_HEADS = "(SELECT l_orderkey AS doc, l_linenumber * 300 + l_partkey % 200 AS pos, l_suppkey % 23 AS rk FROM lineitem)"


@query(
    "toc_runs",
    f"""WITH a AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 400 AND rk > lag(rk) OVER w THEN 0 ELSE 1 END AS nw FROM {_HEADS} WINDOW w AS (PARTITION BY doc ORDER BY pos, rk)),
             b AS (SELECT *, sum(nw) OVER (PARTITION BY doc ORDER BY pos, rk ROWS UNBOUNDED PRECEDING) AS run FROM a),
             c AS (SELECT doc, run, min(pos) AS start, max(pos) AS stop, count(DISTINCT rk) AS n_items FROM b GROUP BY 1, 2)
        SELECT doc, start, stop, n_items FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY start, stop, n_items) AS r FROM c WHERE n_items >= 3) WHERE r = 1""",
)
def toc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First run of close ascending headings of each document."""
    heads = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 300 + F.col("l_partkey") % 200).alias("pos"), (F.col("l_suppkey") % 23).alias("rk"))
    return D.heading_runs(heads, "doc", "pos", "rk", 400, 3)


_CH = """(SELECT doc_id, chunk_index, c AS text FROM (SELECT doc_id, CAST(s / 1300 AS INTEGER) AS chunk_index, substring(text, CAST(s AS INTEGER) + 1, 1500) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS s FROM documents WHERE length(text) > 0)) WHERE chunk_index = 0 OR length(c) >= 300)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of all documents."""
    return D.fixed_chunks(docs(spark, sf_dir), "doc_id", "text")


@query("chunk_fixed", f"SELECT doc_id, chunk_index, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM {_CH}")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows with overlap."""
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


_ST, _EN = "regexp_matches(trim(text), '^[a-z]')", "right(trim(text), 1) NOT IN ('.', '!', '?', ':', ';', '\"', ')')"


@query(
    "chunk_boundary_quality",
    f"SELECT count(*) AS n, round(100.0 * avg(CAST({_ST} AS INTEGER)), 4) AS broken_start, round(100.0 * avg(CAST({_EN} AS INTEGER)), 4) AS broken_end, round(100.0 * avg(CAST(NOT {_ST} AND NOT ({_EN}) AS INTEGER)), 4) AS clean FROM {_CH}",
)
def chunk_boundary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often chunks cut sentences."""
    return D.boundary_quality(chunks(spark, sf_dir))


@query("chunk_stats", f"SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 4) AS mean, round(CAST(median(length(text)) AS DOUBLE), 4) AS median, max(length(text)) AS max, count(*) FILTER (WHERE length(text) > 2000) AS over_limit FROM {_CH}")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the chunks."""
    return D.chunk_stats(chunks(spark, sf_dir))


@query("chunk_fixed_sql", f"SELECT doc_id, chunk_index, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM {_CH}")
def chunk_fixed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from SQL."""
    TF.register(spark)
    return spark.sql("SELECT doc_id, chunk_index, length(c.text) AS n_chars, md5(c.text) AS digest FROM (SELECT doc_id, fixed_chunks(text, 1500, 1300, 300) AS chunks FROM {docs}) AS d, LATERAL inline(d.chunks) AS c", docs=docs(spark, sf_dir))


@query("chunk_structural_sql")
def chunk_structural_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences from SQL."""
    TF.register(spark)
    return spark.sql("SELECT * FROM sentence_chunks(TABLE(SELECT doc_id, bounded_sentences(text) AS parts FROM {docs}), 'parts')", docs=docs(spark, sf_dir))


@query("chunk_structural")
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences."""
    return D.structural_chunks(docs(spark, sf_dir), "doc_id", "text")


@query("corpus_grid", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{v}') AS {v}" for v in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1")
def corpus_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language."""
    return docs(spark, sf_dir).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("corpus_peek", "SELECT doc_id, source, left(text, 80) AS head, right(text, 40) AS tail FROM documents WHERE lang = 'en' AND contains(text, 'the') ORDER BY doc_id LIMIT 20 OFFSET 10")
def corpus_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of matching documents with head and tail."""
    hits = docs(spark, sf_dir).where((F.col("lang") == "en") & F.contains("text", F.lit("the"))).select("doc_id", "source", F.left("text", F.lit(80)).alias("head"), F.right("text", F.lit(40)).alias("tail"))
    return hits.orderBy("doc_id").offset(10).limit(20)


# ------------------------------------------------------------------ retrieval

_TOK = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: NOT list_contains({X.SEARCH_STOP_WORDS}, w))"
_QTEXT = "array_to_string(string_split(text, ' ')[1:8], ' ')"


def _bm25_sql(k: int, scope: str = "TRUE", asked: str = "benchmark") -> str:
    return f"""(WITH d AS (SELECT doc_id AS id, {_TOK('text')} AS w, {scope} AS ok FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
      tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
      df AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n_docs),
      idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
      q AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest({_TOK(_QTEXT)}) AS term FROM {asked}) GROUP BY 1, 2),
      s AS (SELECT qid, id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), st GROUP BY 1, 2),
      a AS (SELECT b.item_id AS qid, d.id, coalesce(s.score, 0) AS score FROM {asked} b CROSS JOIN d LEFT JOIN s ON s.qid = b.item_id AND s.id = d.id WHERE d.ok)
      SELECT qid, CAST(r AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM a) WHERE r <= {k})"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query``: the first eight words of each benchmark text."""
    return parquet(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("query"))


def lexical(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """BM25 run over all documents."""
    return R.bm25(docs(spark, sf_dir), questions(spark, sf_dir), k)


@query("bm25_topk", f"SELECT * FROM {_bm25_sql(8)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight best documents of each question."""
    return lexical(spark, sf_dir)


@query("bm25_scoped", f"SELECT * FROM {_bm25_sql(8, chr(39).join(['lang = ', 'fr', '']))}")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight best French documents; statistics stay those of the corpus."""
    return R.bm25(docs(spark, sf_dir), questions(spark, sf_dir), 8, F.col("lang") == "fr")


@query("bm25_indexed", f"SELECT * FROM {_bm25_sql(8)}")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight best documents of each question, from an index of postings that is built once."""
    return L.index(docs(spark, sf_dir)).search(questions(spark, sf_dir))


@query("bm25_indexed_scoped", f"SELECT * FROM {_bm25_sql(8, chr(39).join(['lang = ', 'fr', '']))}")
def bm25_indexed_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight best French documents of each question, from the index."""
    return L.index(docs(spark, sf_dir), scope=["lang"]).search(questions(spark, sf_dir), scope=F.col("lang") == "fr")


@query("bm25_skipping")
def bm25_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and postings of each question's terms, and how many of them must be read."""
    plan = L.index(docs(spark, sf_dir)).plan(questions(spark, sf_dir))
    return plan.groupBy("qid").agg(F.count("*").alias("blocks"), F.count_if("read").alias("blocks_read"), F.sum("n").alias("postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("postings_read"))


def _dense_sql(k: int) -> str:
    v = "list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE))"
    return f"""(SELECT qid, CAST(r AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (
      SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity({v.format('q')}, {v.format('e')}), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE r <= {k})"""


def semantic(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """Cosine run for every vector whose id is divisible by twenty."""
    e = parquet(spark, sf_dir, "embeddings")
    return R.dense(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), k)


@query("dense_topk", f"SELECT * FROM {_dense_sql(8)}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nearest vectors of each query vector."""
    return semantic(spark, sf_dir)


@query("dense_approx")
def dense_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight near vectors of each query vector, from an index of cells and codes that is built once."""
    e = parquet(spark, sf_dir, "embeddings")
    path = storage.new_folder(spark, "cells")
    V.build(e, path, scope=["label"])
    return V.search(spark, path, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")))


@query("dense_approx_scoped")
def dense_approx_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of one label; the scope is applied before cells are probed."""
    e = parquet(spark, sf_dir, "embeddings")
    path = storage.new_folder(spark, "cells")
    V.build(e, path, scope=["label"])
    return V.search(spark, path, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), scope=F.col("label") == 3)


_OWN = "(SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))"
_OWN_RUNS = f"(SELECT 'bm25' AS engine, * FROM {_bm25_sql(50, 'TRUE', _OWN)} UNION ALL SELECT 'dense', * FROM {_dense_sql(50)} WHERE qid IN (SELECT item_id FROM {_OWN}))"


@query(
    "hybrid_search",
    f"""SELECT qid, CAST(r AS INTEGER) AS rank, id, score, engines FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (
          SELECT qid, id, round(sum(1.0 / CAST(3 + rank AS DOUBLE)), 6) AS score, string_agg(engine, '+' ORDER BY engine) AS engines FROM {_OWN_RUNS} GROUP BY 1, 2)) WHERE r <= 8""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both engines on one question over the same rows: a document's first eight words and its vector, by name from the registry."""
    d, e = docs(spark, sf_dir), parquet(spark, sf_dir, "embeddings")
    words = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("query"))
    asked = words.join(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), "qid")
    return R.search("hybrid", R.Corpus(d, e), asked)


_RUNS = f"(SELECT 'bm25' AS engine, * FROM {_bm25_sql(50)} UNION ALL SELECT 'dense', * FROM {_dense_sql(50)})"


def runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both runs to depth 50."""
    return {"bm25": lexical(spark, sf_dir, 50), "dense": semantic(spark, sf_dir, 50)}


@query(
    "rrf_fusion",
    f"""SELECT qid, CAST(r AS INTEGER) AS rank, id, score, engines FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (
          SELECT qid, id, round(sum(1.0 / CAST(3 + rank AS DOUBLE)), 6) AS score, string_agg(engine, '+' ORDER BY engine) AS engines FROM {_RUNS} GROUP BY 1, 2)) WHERE r <= 8""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused run of both engines."""
    return R.rrf(runs(spark, sf_dir))


@query(
    "rrf_sweep",
    f"""WITH g AS (SELECT constant, depth FROM (SELECT unnest([0, 1, 3, 10, 60]) AS constant), (SELECT unnest([20, 50]) AS depth)), f AS (
          SELECT constant, depth, qid, id, round(sum(1.0 / CAST(constant + rank AS DOUBLE)), 6) AS score FROM {_RUNS}, g WHERE rank <= depth GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY constant, depth, qid ORDER BY score DESC, id) AS r FROM f)
        SELECT CAST(constant AS INTEGER) AS constant, CAST(depth AS INTEGER) AS depth, round(avg(rr), 6) AS mrr FROM (SELECT constant, depth, qid, coalesce(1.0 / CAST(min(CASE WHEN id = qid THEN r END) AS DOUBLE), 0) AS rr FROM k WHERE r <= 8 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def rrf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank of the query's own id under each constant and depth."""
    asked = questions(spark, sf_dir).select("qid").unionByName(parquet(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid")))
    gold = asked.distinct().select("qid", F.col("qid").alias("id"))
    return R.rrf_sweep(runs(spark, sf_dir), gold, [0, 1, 3, 10, 60], [20, 50])


@query("best_window")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best stretch of the first hit of each question."""
    first = lexical(spark, sf_dir, 1).join(questions(spark, sf_dir), "qid")
    hit = first.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    return hit.select("qid", "id", R.best_window(hit, "text", "query").alias("window"))


@query(
    "build_context",
    f"SELECT qid, string_agg('[' || rank || '] ' || left(text, 200), chr(10) || chr(10) ORDER BY rank) AS context FROM {_bm25_sql(3)} JOIN documents ON id = doc_id GROUP BY 1",
)
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered excerpts of the three best hits."""
    hits = lexical(spark, sf_dir, 3).join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.left("text", F.lit(200)).alias("t")), "id")
    piece = F.struct("rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("t")).alias("p"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["p"]), "\n\n").alias("context"))


# ------------------------------------------------------------------ evaluation

_FLAT = lambda x: _COLLAPSE(x)
_WIN = f"""(SELECT gold, unnest(CASE WHEN n <= 160 THEN [b] ELSE [substring(b, least(CAST(floor(n * 0.3) AS INTEGER), n - 160) + 1, 160), substring(b, least(CAST(floor(n * 0.5) AS INTEGER), n - 160) + 1, 160), substring(b, least(CAST(floor(n * 0.7) AS INTEGER), n - 160) + 1, 160)] END) AS win
             FROM (SELECT item_id AS gold, {_FLAT('text')} AS b, CAST(length({_FLAT('text')}) AS INTEGER) AS n FROM benchmark))"""
_MATCH = f"(SELECT DISTINCT gold, doc_id AS id FROM {_WIN} JOIN (SELECT doc_id, {_FLAT('text')} AS body FROM documents) ON contains(body, win))"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passages that documents contain."""
    win = parquet(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gold"), F.explode(D.windows(X.collapse(F.col("text")))).alias("window"))
    return E.content_match(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), X.collapse(F.col("text")).alias("body")), win)


@query("content_match", f"SELECT * FROM {_MATCH}")
def content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold windows found in documents."""
    return matches(spark, sf_dir)


_IR = f"""(SELECT b.item_id AS qid, CASE WHEN f.n > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(f.n, 0) / 1.0, 6) AS recall, round(coalesce(1.0 / CAST(f.r AS DOUBLE), 0), 6) AS mrr FROM benchmark b
           LEFT JOIN (SELECT qid, count(DISTINCT gold) AS n, min(rank) AS r FROM {_bm25_sql(8)} JOIN {_MATCH} USING (id) WHERE gold = qid GROUP BY 1) f ON f.qid = b.item_id)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall and reciprocal rank of each question."""
    gold = parquet(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("gold"))
    return E.ir_metrics(lexical(spark, sf_dir), gold, matches(spark, sf_dir), 8)


@query(
    "ir_metrics",
    f"SELECT coalesce(CAST(qid % 4 AS VARCHAR), 'TOTAL') AS category, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM {_IR} GROUP BY GROUPING SETS ((qid % 4), ())",
)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages by category and in total, from one grouping-sets pass."""
    m = metrics(spark, sf_dir).withColumn("category", (F.col("qid") % 4).cast("string"))
    out = m.groupingSets([["category"], []], "category").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr")])
    return out.select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "n", "hit", "recall", "mrr")


@query("ir_pool_gap", f"SELECT round(avg(mrr) FILTER (WHERE qid % 2 = 0), 6) AS narrow, round(avg(mrr) FILTER (WHERE qid % 2 = 1), 6) AS wide, round(avg(mrr) FILTER (WHERE qid % 2 = 0) - avg(mrr) FILTER (WHERE qid % 2 = 1), 6) AS gap FROM {_IR}")
def ir_pool_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric by labelling block, and the gap."""
    even, odd = (F.avg(F.when(F.col("qid") % 2 == i, F.col("mrr"))) for i in (0, 1))
    return metrics(spark, sf_dir).agg(F.round(even, 6).alias("narrow"), F.round(odd, 6).alias("wide"), F.round(even - odd, 6).alias("gap"))


@query(
    "pooled_candidates",
    f"""WITH e AS (SELECT qid, id, min(rank * 10 + CASE engine WHEN 'bm25' THEN 0 ELSE 1 END) AS k FROM {_RUNS} WHERE rank <= 12 GROUP BY 1, 2)
        SELECT qid, id, CAST(r AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS r FROM e) WHERE r <= 18""",
)
def pooled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin pool of both engines, eighteen at most."""
    both = [r.where("rank <= 12").select("qid", "id", (F.col("rank") * 10 + i).alias("k")) for i, r in enumerate(runs(spark, sf_dir).values())]
    best = both[0].unionByName(both[1]).groupBy("qid", "id").agg(F.min("k").alias("k"))
    w = Window.partitionBy("qid").orderBy("k", "id")
    return best.withColumn("pos", F.row_number().over(w)).where("pos <= 18").select("qid", "id", "pos")


_ANS = "(SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'NO ANSWER' ELSE 'see [' || (1 + conv_id % 4) || '] and [' || (1 + turn) || '] [' || (1 + conv_id % 4) || ']' END AS answer, CAST(3 AS INTEGER) AS n_given, conv_id % 5 = 0 AS must_abstain FROM conversations WHERE role = 'assistant')"
_CITE = f"(SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,6}})\\]', 1), lambda v: CAST(v AS INTEGER)))) AS cited FROM {_ANS})"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citation marks, one for each assistant turn."""
    c = parquet(spark, sf_dir, "conversations").where("role = 'assistant'")
    text = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "NO ANSWER").otherwise(F.format_string("see [%d] and [%d] [%d]", 1 + F.col("conv_id") % 4, 1 + F.col("turn"), 1 + F.col("conv_id") % 4))
    return c.select("conv_id", "turn", text.alias("answer"), F.lit(3).alias("n_given"), (F.col("conv_id") % 5 == 0).alias("must_abstain"))


@query("citation_metrics", f"SELECT conv_id, turn, CAST(len(cited) AS INTEGER) AS n_cited, CAST(len(list_filter(cited, lambda v: v < 1 OR v > n_given)) AS INTEGER) AS n_invalid FROM {_CITE}")
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited and invalid numbers of each answer."""
    c = answers(spark, sf_dir).withColumn("c", E.citations(F.col("answer"), F.col("n_given")))
    return c.select("conv_id", "turn", F.size("c.cited").alias("n_cited"), F.size("c.invalid").alias("n_invalid"))


_GIVEN = f"""(SELECT c.conv_id, c.turn, list_transform(list_filter(c.cited, lambda v: v BETWEEN 1 AND 3), lambda v: [left(t.text, 40), right(t.text, 40), 'none'][v]) AS texts, {_COLLAPSE('substring(t.text, 5, 10)')} AS w
                  FROM {_CITE} c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn AND t.role = 'assistant')"""


@query(
    "citation_precision",
    f"""SELECT conv_id, turn, array_to_string(texts, '|') AS cited, CASE WHEN len(texts) > 0 THEN round(len(list_filter(texts, lambda t: contains({_COLLAPSE('t')}, w))) / CAST(len(texts) AS DOUBLE), 6) END AS precision FROM {_GIVEN}""",
)
def citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpts that each answer cites, by position, and the share of them that holds the gold window."""
    text = parquet(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    both = answers(spark, sf_dir).join(text, ["conv_id", "turn"])
    given = F.array(F.left("text", F.lit(40)), F.right("text", F.lit(40)), F.lit("none"))
    held = both.select("conv_id", "turn", E.citations(F.col("answer"), F.col("n_given"))["cited"].alias("c"), given.alias("given"), F.array(F.substring("text", 5, 10)).alias("w"))
    precision = F.round(E.citation_precision(F.col("c"), F.col("given"), F.col("w")), 6)
    return held.select("conv_id", "turn", F.array_join(E.cited_texts(F.col("c"), F.col("given")), "|").alias("cited"), precision.alias("precision"))


_NAMES = {"de": [" der ", " und "], "en": [" the ", " and "], "es": [" los ", " que "], "fr": [" les ", " dans "]}
_NAMED = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{n}')" for n in ns) + f" THEN '{k}' END" for k, ns in _NAMES.items())


@query("named_scope", f"SELECT doc_id, CASE WHEN n = '' THEN '{'+'.join(_NAMES)}' ELSE n END AS scope FROM (SELECT doc_id, concat_ws('+', {_NAMED}) AS n FROM documents)")
def named_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some named scopes a text speaks of; all of them where it names none."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(E.named(F.col("text"), _NAMES), "+").alias("scope"))


_ITEM = "CASE doc_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '3' WHEN 3 THEN '7' WHEN 4 THEN '99' END"
_TITLE = "CASE {0} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in D.ITEM_TITLES.items()) + " ELSE '' END"


@query(
    "context_headers",
    f"""SELECT doc_id, upper(source) || ' fiscal year ' || (2020 + doc_id % 5) || ' 10-K, ' || CASE WHEN item IS NULL THEN 'full filing' ELSE regexp_replace('Item ' || item || '. ' || {_TITLE.format('item')}, '^[. ]+|[. ]+$', '', 'g') END AS header
        FROM (SELECT *, {_ITEM} AS item FROM documents)""",
)
def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that tells where each chunk is from."""
    item = F.expr(_ITEM)
    return docs(spark, sf_dir).select("doc_id", D.context_header(F.upper("source"), (2020 + F.col("doc_id") % 5), item).alias("header"))


@query(
    "abstention_report",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE must_abstain AND a) AS right_abstain, count(*) FILTER (WHERE NOT must_abstain AND a) AS wrong_abstain,
               round(100.0 * count(*) FILTER (WHERE must_abstain AND a) / CAST(greatest(1, count(*) FILTER (WHERE must_abstain)) AS DOUBLE), 4) AS right_pct,
               count(*) FILTER (WHERE NOT a AND contains(answer, '[')) AS with_citation FROM (SELECT *, starts_with(answer, 'NO ANSWER') AS a FROM {_ANS})""",
)
def abstention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions against what was asked for."""
    a, m = F.startswith("answer", F.lit("NO ANSWER")), F.col("must_abstain")
    return answers(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(m & a).alias("right_abstain"), F.count_if(~m & a).alias("wrong_abstain"),
        F.round(100.0 * F.count_if(m & a) / F.greatest(F.lit(1), F.count_if(m)), 4).alias("right_pct"), F.count_if(~a & F.contains("answer", F.lit("["))).alias("with_citation"),
    )


@query(
    "label_progress",
    "SELECT lang, count(*) FILTER (WHERE quality IS NOT NULL) AS done, count(*) FILTER (WHERE quality IS NULL) AS pending, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1",
)
def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and pending documents by language."""
    both = docs(spark, sf_dir).where("lang is not null").select("doc_id", "lang").join(parquet(spark, sf_dir, "labels"), "doc_id", "left")
    done = F.col("quality").isNotNull()
    return both.groupBy("lang").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("pending"), F.count("*").alias("total"))


_V = "CASE WHEN {0} = 1 THEN 'faithful' WHEN doc_id % 11 = 0 THEN 'unsure' ELSE 'unfaithful' END"


@query(
    "kappa",
    f"""WITH p AS (SELECT * FROM (SELECT {_V.format('quality')} AS a, {_V.format('toxic')} AS b FROM labels) WHERE a <> 'unsure' AND b <> 'unsure'), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM p),
             e AS (SELECT sum(x.c * y.c) / CAST((SELECT n * n FROM n) AS DOUBLE) AS pe FROM (SELECT a, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM p GROUP BY 1) y ON x.a = y.b), k AS (SELECT n, po, pe, CASE WHEN pe = 1 THEN 0 ELSE (po - pe) / (1 - pe) END AS k FROM n, e)
        SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round(k, 6) AS kappa, CASE WHEN k >= .81 THEN 'almost perfect' WHEN k >= .61 THEN 'substantial' WHEN k >= .41 THEN 'moderate' WHEN k >= .21 THEN 'fair' WHEN k >= 0 THEN 'slight' ELSE 'below chance' END AS band FROM k""",
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two verdicts, unsure ones left out."""
    v = lambda c: F.when(F.col(c) == 1, "faithful").when(F.col("doc_id") % 11 == 0, "unsure").otherwise("unfaithful")
    return E.kappa(parquet(spark, sf_dir, "labels").select(v("quality").alias("a"), v("toxic").alias("b")), "a", "b")


@query(
    "mcnemar",
    """WITH d AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS b, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS c FROM labels)
       SELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(CAST(b + c + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(b + c - i + 1 AS DOUBLE)) - (b + c) * ln(2.0))) FROM (SELECT unnest(range(least(b, c) + 1)) AS i))), 6) END AS p FROM d""",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact test on discordant labels."""
    a = (F.col("quality") == 1) & (F.col("toxic") != 1)
    b = (F.col("quality") != 1) & (F.col("toxic") == 1)
    return E.mcnemar(parquet(spark, sf_dir, "labels"), a, b)


_TF = f"""(WITH d AS (SELECT doc_id AS id, {_CLEAN} AS w FROM documents), g AS (SELECT id, unnest(w || CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term FROM d),
       tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 5 ORDER BY cf DESC, term LIMIT 10000),
       x AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / CAST(1.0 + df AS DOUBLE)) + 1) AS x FROM tf JOIN v USING (term)) SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM x)"""


@query("tfidf_terms", f"SELECT id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS r FROM {_TF}) WHERE r <= 10")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest terms of each document."""
    return R.tfidf(docs(spark, sf_dir), F.col("text"), k=10, split=X.clean_lists)


_COEF = "(SELECT term, round(avg(CASE WHEN quality = 1 THEN weight ELSE 0 END) - avg(CASE WHEN quality = 0 THEN weight ELSE 0 END), 8) AS coef FROM t JOIN labels ON id = doc_id GROUP BY 1)"


@query(
    "term_contributions",
    f"""WITH t AS {_TF}, c AS {_COEF}, p AS (SELECT term, round(weight * coef, 8) AS contribution FROM t JOIN c USING (term) WHERE id = 1)
        SELECT * FROM (SELECT 'positive' AS side, * FROM p ORDER BY contribution DESC, term LIMIT 5) UNION ALL SELECT * FROM (SELECT 'negative' AS side, * FROM p ORDER BY contribution, term LIMIT 5)""",
)
def term_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that move one document's score most, both ways."""
    d, text, split = docs(spark, sf_dir), F.col("text"), X.clean_lists
    idf = R.tfidf_vocabulary(d, text, split=split)
    own = R.tfidf_weights(d.where("doc_id = 1"), text, idf, split=split)
    t = R.tfidf_weights(d, text, idf, only=[r["term"] for r in own.select("term").collect()], split=split)  # no other term has a part in it
    one = t.join(parquet(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id"))
    side = lambda q: F.avg(F.when(F.col("quality") == q, F.col("weight")).otherwise(0.0))
    coef = one.groupBy("term").agg(F.round(side(1) - side(0), 8).alias("coef"))
    p = own.join(coef, "term").select("term", F.round(F.col("weight") * F.col("coef"), 8).alias("contribution"))
    up = p.orderBy(F.desc("contribution"), "term").limit(5).select(F.lit("positive").alias("side"), "*")
    return up.unionByName(p.orderBy("contribution", "term").limit(5).select(F.lit("negative").alias("side"), "*"))


@query(
    "softmax_probs",
    """SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS pred, round(list_max(e) / list_sum(e), 4) AS confidence FROM (SELECT vec_id, list_transform(embedding[1:10], lambda x: exp(10 * CAST(x AS DOUBLE))) AS e FROM embeddings)""",
)
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and confidence of ten scores."""
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(10 * x.cast("double")))
    held = parquet(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return held.select("vec_id", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("pred"), F.round(F.array_max("e") / total, 4).alias("confidence"))


@query("score_text")
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment-style serving: label and confidence of each document, with an error column."""
    from granum.plans.profile import ml_naive_bayes

    scored = ml_naive_bayes(spark, sf_dir).select("doc_id", F.when(F.col("p_1") >= 0.5, "positive").otherwise("negative").alias("sentiment"), F.round(F.greatest("p_1", 1 - F.col("p_1")), 4).alias("confidence"))
    given = docs(spark, sf_dir).select("doc_id", F.when(F.length(F.trim("text")) == 0, "empty text").alias("error"))
    return given.join(scored, "doc_id", "left")


_EVENTS = "(SELECT user_id, ts FROM events WHERE ts IS NOT NULL)"


@query("stream_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hourly counts of the events read as a stream, as they stand at its end."""
    return W.run_to_table(W.hourly_counts(W.read_stream(spark, f"{sf_dir}/events.parquet"), late="3650 days"))


@query(
    "stream_sliding",
    f"""SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT unnest([to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC', to_timestamp(floor(epoch(ts) / 21600) * 21600 - 21600) AT TIME ZONE 'UTC']) AS s FROM {_EVENTS}) GROUP BY 1""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of twelve hours every six, of the events read as a stream."""
    counts = W.run_to_table(W.sliding_counts(W.read_stream(spark, f"{sf_dir}/events.parquet"), "12 hours", "6 hours", late="3650 days"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query(
    "session_windows",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
             s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps under thirty minutes."""
    out = W.sessions(parquet(spark, sf_dir, "events"), "user_id", "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("stop", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
             s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
             t AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k)
        SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS stop, n FROM t WHERE b <= (SELECT max(ts) FROM {_EVENTS}) - INTERVAL 2 HOUR""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events read as a stream that are closed two hours before its last event."""
    out = W.run_to_table(W.sessions(W.read_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "30 minutes", late="2 hours"), "append")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("stop", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")


@query("stream_incremental", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream that are not in the labels yet."""
    from granum.operators.sources import incremental

    new = W.read_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id")
    return W.run_to_table(incremental(new, parquet(spark, sf_dir, "labels"), ["doc_id"]), "append")


@query("stream_scores")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream and scored by the fitted naive Bayes pipeline."""
    from granum.plans.profile import text_pipeline

    model = text_pipeline(spark, sf_dir)
    rows = W.read_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return W.run_to_table(W.score(rows.where("text is not null"), model).select("doc_id", "prediction", "confidence"), "append")
