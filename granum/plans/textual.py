"""Text rules and feature shares over documents, and integration of sources."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granum import storage
from granum.functions import text as X
from granum.operators import cleaning as L
from granum.operators import sources as I
from granum.plans.registry import query
from granum.sources import variants as V
from granum.sources.tables import parquet
from granum.sources.versioned import VersionedTable
from granum.streaming import windows as W

_q = lambda s: "'" + s.replace("'", "''") + "'"
_COLLAPSE = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _unescape_sql(x: str) -> str:
    """Entities of the Latin-1 range with or without a semicolon, longer names first, ampersands last."""
    names = sorted((n for n, c in name2codepoint.items() if c < 256 and n not in ("amp", "nbsp")), key=lambda n: (-len(n), n))
    for k, v in [*((f"&{n};?", chr(name2codepoint[n])) for n in names), ("&#39;", "'"), ("&nbsp;?", " "), ("&amp;?", "&")]:
        x = f"regexp_replace({x}, {_q(k)}, {_q(v)}, 'g')"
    return x


_NORM = lambda x: "lower(regexp_replace(translate(" + _unescape_sql(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')") + f", '{X.ACCENTED}', '{X.PLAIN}'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_CLEAN = (
    "list_filter(string_split(lower(" + _COLLAPSE("regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[^a-zA-Z \\t\\n\\r]', '', 'g')")
    + f"), ' '), lambda w: len(w) > 2 AND NOT list_contains([{', '.join(map(_q, X.STOP_WORDS))}], w))"
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return parquet(spark, sf_dir, "documents")


@query("clean_text", f"SELECT doc_id, array_to_string({_CLEAN}, ' ') AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review cleaning without a lexicon, so every word is its own lemma."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.clean_words(F.col("text")), " ").alias("clean"))


_FORMS = " UNION ALL ".join(
    [
        "SELECT word, word AS form, 0 AS nth FROM v",
        *[
            f"SELECT word, left(word, length(word) - {len(end)}) || {_q(new)}, {i} FROM v WHERE word LIKE {_q('%' + end)}" + (" AND word NOT LIKE '%ss'" if end == "s" else "")
            for i, (end, new) in enumerate(X.NOUN_ENDINGS, 1)
        ],
    ]
)


@query(
    "clean_lemmas",
    f"""WITH c AS (SELECT doc_id, {_CLEAN} AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM c),
    v AS (SELECT DISTINCT word FROM t), f AS ({_FORMS}), l AS (SELECT word, arg_min(form, length(form) * 100 + nth) AS lemma FROM f WHERE form IN (SELECT word FROM v) GROUP BY word),
    j AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS clean FROM t JOIN l USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(clean, '') AS clean FROM c LEFT JOIN j USING (doc_id)""",
)
def clean_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review cleaning with lemmas; the lexicon is the corpus's own words."""
    return L.clean_text(docs(spark, sf_dir), "doc_id", "text")


@query("normalize_text", f"SELECT doc_id, md5({_NORM('text')}) AS norm_md5 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the normalised text."""
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm_md5"))


@query("review_length", "SELECT lang, round(avg(len(string_split(trim(text), ' '))), 4) AS mean_words, round(CAST(median(len(string_split(trim(text), ' '))) AS DOUBLE), 4) AS median_words FROM documents GROUP BY 1")
def review_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by language."""
    n = F.size(F.split(F.trim("text"), " "))
    return docs(spark, sf_dir).select("lang", n.alias("n")).groupBy("lang").agg(F.round(F.avg("n"), 4).alias("mean_words"), F.round(F.median("n"), 4).alias("median_words"))


@query(
    "top_words",
    f"""SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT lang, unnest({_CLEAN}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2) WHERE r <= 15""",
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen most frequent cleaned words of each language."""
    by = docs(spark, sf_dir).where("lang is not null").select("lang", F.explode(X.clean_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return by.withColumn("r", F.row_number().over(w)).where("r <= 15").drop("r")


#: Patterns of the documents' own vocabulary, valid in both regular-expression engines.
_TOOLS = {"license": "licen[sc]e", "mail": "@[a-z0-9]+[.]", "digits": "[0-9]{6}", "table": "[|]", "shout": "!!", "url": "https?://", "article": "(^|[^a-z])(the|der|la|el)([^a-z]|$)"}
_N = f"(SELECT doc_id, lang, source, n_chars, {_NORM('text')} AS x FROM documents)"
_FLAGS_SQL = ", ".join(f"regexp_matches(x, {_q(p)}) AS has_{k}" for k, p in _TOOLS.items())


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the normalised text computed once, before any pattern reads it."""
    return docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", X.normalize(F.col("text")).alias("x"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boolean for each pattern."""
    return normed(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", *[F.col("x").rlike(p).alias(f"has_{k}") for k, p in _TOOLS.items()])


_HAS = [f"has_{k}" for k in _TOOLS]
_F = f"(SELECT doc_id, lang, source, n_chars, {_FLAGS_SQL} FROM {_N})"


@query("tool_flags", f"SELECT doc_id, {', '.join(_HAS)} FROM {_F}")
def tool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern flags of each document."""
    return flagged(spark, sf_dir).select("doc_id", *_HAS)


_GROUPS = {"contact": ["has_mail", "has_url"], "junk": ["has_table", "has_shout"], "legal": ["has_license"]}


@query("hype_groups", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS grp, round(100.0 * avg(CAST({' OR '.join(c)} AS INTEGER)), 4) AS share FROM {_F}" for g, c in _GROUPS.items()) + ")")
def hype_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with any flag of a group."""
    one = flagged(spark, sf_dir).agg(*[F.round(100.0 * F.avg(F.expr(" or ".join(c)).cast("int")), 4).alias(g) for g, c in _GROUPS.items()])
    return one.unpivot([], list(_GROUPS), "grp", "share")


_SHARE = lambda by: " UNION ALL ".join(f"SELECT {by}, '{c}' AS tool, round(100.0 * avg(CAST({c} AS INTEGER)), 4) AS share FROM {_F} WHERE {by} IS NOT NULL GROUP BY 1" for c in _HAS)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each flag by language, long form."""
    by = flagged(spark, sf_dir).where("lang is not null").groupBy("lang").agg(*[F.round(100.0 * F.avg(F.col(c).cast("int")), 4).alias(c) for c in _HAS])
    return by.unpivot(["lang"], _HAS, "tool", "share")


@query("tool_share_by_region", f"WITH s AS ({_SHARE('lang')}) SELECT tool, max(share) FILTER (WHERE lang = 'de') AS de, max(share) FILTER (WHERE lang = 'en') AS en, max(share) FILTER (WHERE lang = 'es') AS es, max(share) FILTER (WHERE lang = 'fr') AS fr FROM s GROUP BY 1")
def tool_share_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag shares by language, one column each."""
    return shares(spark, sf_dir).groupBy("tool").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("share"))


@query("tool_summary", " UNION ALL ".join(f"SELECT '{c}' AS tool, count(*) FILTER (WHERE {c}) AS n, round(100.0 * count(*) FILTER (WHERE {c}) / CAST(count(*) AS DOUBLE), 1) AS pct FROM {_F}" for c in _HAS))
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and share of each flag, in one pass."""
    one = flagged(spark, sf_dir).agg(F.count("*").alias("t"), *[F.count_if(c).alias(c) for c in _HAS])
    return one.unpivot(["t"], _HAS, "tool", "n").select("tool", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("pct"))


@query(
    "spearman_regions",
    f"""WITH s AS ({_SHARE('lang')}), r AS (SELECT lang, tool, rank() OVER (PARTITION BY lang ORDER BY share) + (count(*) OVER (PARTITION BY lang, share) - 1) / 2.0 AS k FROM s)
        SELECT a.lang AS lang_1, b.lang AS lang_2, round(corr(a.k, b.k), 4) AS rho FROM r a JOIN r b ON a.tool = b.tool AND a.lang < b.lang GROUP BY 1, 2""",
)
def spearman_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of flag shares between languages, ties by average rank."""
    s = shares(spark, sf_dir)
    k = F.rank().over(Window.partitionBy("lang").orderBy("share")) + (F.count("*").over(Window.partitionBy("lang", "share")) - 1) / 2.0
    # one row of every language's ranks (few languages, few flags), paired with itself
    ranks = s.select("lang", "tool", k.alias("k")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("tool", "k"))).alias("ks"))
    every = ranks.agg(F.array_sort(F.collect_list(F.struct("lang", "ks"))).alias("all"))
    first = every.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    cells = first.select(F.col("a.lang").alias("lang_1"), F.col("b.lang").alias("lang_2"), F.explode(F.arrays_zip(F.col("a.ks").alias("x"), F.col("b.ks").alias("y"))).alias("z"))
    return cells.groupBy("lang_1", "lang_2").agg(F.round(F.corr("z.x.k", "z.y.k"), 4).alias("rho"))


@query(
    "crosstab_share",
    "SELECT lang, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE quality = {k}) / CAST(count(*) AS DOUBLE), 4) AS q{k}" for k in (0, 1)) + " FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1",
)
def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row percentages of quality by language."""
    df = docs(spark, sf_dir).where("lang is not null").select("doc_id", "lang").join(parquet(spark, sf_dir, "labels"), "doc_id")
    return df.groupBy("lang").agg(*[F.round(100.0 * F.count_if(F.col("quality") == k) / F.count("*"), 4).alias(f"q{k}") for k in (0, 1)])


@query("years_required", f"SELECT doc_id, list_min(list_filter(list_transform(regexp_extract_all(x, '([0-9]+) ', 1), lambda v: TRY_CAST(v AS INTEGER)), lambda v: v > 0 AND v <= 20)) AS years FROM {_N}")
def years_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest number in 1 to 20 before a space."""
    return normed(spark, sf_dir).select("doc_id", X.least_years(F.col("x"), "([0-9]+) ").alias("years"))


_TITLES = [("licen[sc]e", "legal"), ("!!", "shouting"), ("[|]", "table"), ("(^|[^a-z])(the|of|and)([^a-z]|$)", "english"), ("(ung|sch|lich)", "german"), ("(cion|ado)", "spanish")]
_CASE = lambda rules, x, d: "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(p)}) THEN '{v}'" for p, v in rules) + f" ELSE '{d}' END"


@query("title_bucket", f"SELECT doc_id, {_CASE(_TITLES, 'x', 'other')} AS bucket FROM {_N}")
def title_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rule."""
    return normed(spark, sf_dir).select("doc_id", X.first_match(F.col("x"), _TITLES, "other").alias("bucket"))


# Region rules in the order they are tried.
_REGIONS = [("africa|algeria|egypt|ethiopia|kenya|morocco|mozambique", "Africa"), ("argentina|brazil|peru|latin america", "LATAM"), ("united states|canada|america", "US/Canada"), ("france|germany|romania|russia|united kingdom", "Europe")]


@query("region_bucket", f"SELECT n_nationkey, {_CASE(_REGIONS, 'lower(n_name)', 'Other')} AS bucket FROM nation")
def region_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of a place name by ordered rules."""
    return parquet(spark, sf_dir, "nation").select("n_nationkey", X.first_match(F.lower("n_name"), _REGIONS, "Other").alias("bucket"))


@query(
    "seniority_map",
    "SELECT o_orderkey, CASE WHEN k = '1-urgent' THEN 'lead' WHEN k = '5-low' THEN 'junior' WHEN contains(k, 'high') THEN 'senior' WHEN contains(k, 'medium') THEN 'mid' END AS level FROM (SELECT o_orderkey, lower(trim(o_orderpriority)) AS k FROM orders)",
)
def seniority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookup, then first contained key, else null."""
    return parquet(spark, sf_dir, "orders").select("o_orderkey", X.lookup(F.col("o_orderpriority"), {"1-urgent": "lead", "5-low": "junior"}, [("high", "senior"), ("medium", "mid")]).alias("level"))


_VOCAB = {"en": ["(^|[^a-z])the ", " of ", " and "], "de": [" der ", " und ", " die "], "fr": [" les? ", " des ", " une? "], "es": [" el ", " los ", " del "]}
_C = ", ".join(" + ".join(f"CAST(regexp_matches(x, {_q(p)}) AS INTEGER)" for p in ps) + f" AS c_{k}" for k, ps in _VOCAB.items())


@query(
    "task_profile",
    f"""SELECT doc_id, CASE WHEN b[1] = 0 THEN 'none' WHEN b[1] < 2 THEN 'weak' WHEN b[1] - b[2] < 2 THEN 'mixed' ELSE ['en','de','fr','es'][list_position(c, b[1])] END AS profile, src AS source FROM (
          SELECT doc_id, src, [c_en, c_de, c_fr, c_es] AS c, list_reverse_sort([c_en, c_de, c_fr, c_es]) AS b FROM (SELECT doc_id, src, {_C} FROM (SELECT doc_id, CASE WHEN length(x) >= 80 THEN x ELSE '' END AS x, CASE WHEN length(x) >= 80 THEN 'tasks' ELSE 'description' END AS src FROM {_N})))""",
)
def task_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading vocabulary of a document."""
    p = normed(spark, sf_dir).select("doc_id", X.task_profile(F.col("x"), _VOCAB, F.lit("")).alias("p"))
    return p.select("doc_id", "p.profile", "p.source")


@query("scope_flags", "SELECT doc_id, CASE WHEN lang IS NULL THEN 'no language' WHEN n_chars < 300 THEN 'too short' WHEN source IN ('src0', 'src1') THEN 'excluded source' ELSE 'in scope' END AS reason FROM documents")
def scope_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document is in or out of scope."""
    why = F.when(F.col("lang").isNull(), "no language").when(F.col("n_chars") < 300, "too short").when(F.col("source").isin("src0", "src1"), "excluded source").otherwise("in scope")
    return docs(spark, sf_dir).select("doc_id", why.alias("reason"))


_ORDER = ["en", "de", "es", "fr", "it"]


@query("seniority_median", f"SELECT pos, lang, m AS median_chars FROM (SELECT CAST(unnest(range({len(_ORDER)})) AS INTEGER) AS pos, unnest({_ORDER}) AS lang) LEFT JOIN (SELECT lang, round(CAST(median(n_chars) AS DOUBLE), 4) AS m FROM documents GROUP BY 1) USING (lang)")
def seniority_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians in a fixed category order, absent ones null."""
    order = spark.createDataFrame(list(enumerate(_ORDER)), "pos int, lang string")
    by = docs(spark, sf_dir).where("lang is not null").groupBy("lang").agg(F.round(F.median("n_chars"), 4).alias("median_chars"))
    return order.join(by, "lang", "left").select("pos", "lang", "median_chars")


_BINS = [(500, "0-500"), (1000, "501-1000"), (2000, "1001-2000"), (5000, "2001-5000")]


@query("competition_buckets", "SELECT CASE " + " ".join(f"WHEN n_chars <= {t} THEN '{v}'" for t, v in _BINS) + " ELSE '>5000' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def competition_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in right-closed bins."""
    label = F.lit(">5000")
    for t, v in reversed(_BINS):
        label = F.when(F.col("n_chars") <= t, v).otherwise(label)
    return docs(spark, sf_dir).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


@query("salary_transparency", "SELECT l_returnflag, count(*) AS n, round(100.0 * count(d) / CAST(count(*) AS DOUBLE), 4) AS pct_given, round(median(d), 4) AS median_given FROM (SELECT l_returnflag, nullif(l_discount, 0) AS d FROM lineitem) GROUP BY 1")
def salary_transparency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with a value, and its median."""
    d = F.nullif("l_discount", F.lit(0.0))
    return parquet(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(100.0 * F.count(d) / F.count("*"), 4).alias("pct_given"), F.round(F.median(d), 4).alias("median_given"))


@query(
    "report_findings",
    f"""SELECT 'volume' AS section, 'documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'volume', 'languages', CAST(count(DISTINCT lang) AS DOUBLE) FROM documents
        UNION ALL SELECT 'length', 'median_chars', round(CAST(median(n_chars) AS DOUBLE), 4) FROM documents UNION ALL SELECT 'content', 'license_pct', round(100.0 * avg(CAST(has_license AS INTEGER)), 4) FROM {_F}""",
)
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's figures as rows, from one pass."""
    one = flagged(spark, sf_dir).agg(F.count("*").cast("double").alias("a"), F.count_distinct("lang").cast("double").alias("b"), F.round(F.median("n_chars"), 4).alias("c"), F.round(100.0 * F.avg(F.col("has_license").cast("int")), 4).alias("d"))
    names = (("volume", "documents", "a"), ("volume", "languages", "b"), ("length", "median_chars", "c"), ("content", "license_pct", "d"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(c).alias("value")) for s, m, c in names])))


# ------------------------------------------------------------------ integration


@query("union_sources", "SELECT 'customer' AS source, c_custkey AS id, c_name AS title, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources in one record shape; fields a source lacks are null."""
    t = lambda n: parquet(spark, sf_dir, n)
    return I.union_records(
        {
            "customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("amount")),
            "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("amount")),
            "part": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")),
        }
    )


@query("dedup_last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, by map-side maxima instead of a window."""
    return I.latest(parquet(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("latest_per_key", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer."""
    return I.latest(parquet(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("coverage_gaps", "SELECT source, lang FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT unnest(['de','en','es','fr','it']) AS lang) EXCEPT SELECT source, lang FROM documents")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected (source, language) pairs that no document has."""
    have = docs(spark, sf_dir).select("source", "lang").distinct()
    want = have.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ["de", "en", "es", "fr", "it"]))).alias("lang"))
    return want.join(have, ["source", "lang"], "left_anti")


@query("set_ops", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an intersection and a difference of keys."""
    a, b = docs(spark, sf_dir).select("doc_id"), parquet(spark, sf_dir, "labels").select("doc_id")
    both = a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n")
    return both.unionByName(a.exceptAll(b).distinct().agg(F.count("*").alias("n")).select(F.lit("documents only").alias("part"), "n"))


@query("incremental_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not yet processed."""
    return docs(spark, sf_dir).select("doc_id").join(parquet(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("soa_to_rows", "SELECT n_regionkey, unnest(list(n_nationkey ORDER BY n_nationkey)) AS nationkey, unnest(list(n_name ORDER BY n_nationkey)) AS name FROM nation GROUP BY 1")
def soa_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays turned into rows."""
    held = parquet(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("z"))
    arrays = held.select("n_regionkey", F.col("z.n_nationkey").alias("nationkey"), F.col("z.n_name").alias("name"))
    return I.arrays_to_rows(arrays, ["nationkey", "name"])


_REV = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'si' WHEN doc_id % 7 = 0 THEN ' No ' ELSE '' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN 'fixed' ELSE '' END AS correction FROM labels)"


@query(
    "review_override",
    f"""SELECT doc_id, label, CASE WHEN v IN ('si', 'sí', 'ok', 'yes') THEN 'confirmado' WHEN c <> '' THEN 'revision_manual' ELSE 'clasificador' END AS origin FROM (
          SELECT d.doc_id, coalesce(nullif(lower(trim(coalesce(correction, ''))), ''), lang) AS label, lower(trim(coalesce(verdict, ''))) AS v, lower(trim(coalesce(correction, ''))) AS c FROM documents d LEFT JOIN {_REV} USING (doc_id)) WHERE v NOT IN ('no', 'descartar', 'fuera')""",
)
def review_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after manual review."""
    k = F.col("doc_id")
    sheet = parquet(spark, sf_dir, "labels").select("doc_id", F.when(k % 3 == 0, "si").when(k % 7 == 0, " No ").otherwise("").alias("verdict"), F.when(k % 5 == 0, "fixed").otherwise("").alias("correction"))
    return I.review_override(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), sheet, "doc_id", {"fixed"})


@query("slug_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as parts of an address."""
    return parquet(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_brand", F.lit(" "), "p_name", F.lit("!"))).alias("slug"))


@query(
    "filled_entries",
    "SELECT event_id, concat_ws(',', CASE WHEN value IS NOT NULL THEN 'value' END, CASE WHEN nullif(event_type, 'click') IS NOT NULL THEN 'kind' END, CASE WHEN user_id IS NOT NULL THEN 'user' END) AS names FROM events",
)
def filled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries of each event's metadata are filled, null ones dropped from the map."""
    entries = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("kind"), F.nullif("event_type", F.lit("click")), F.lit("user"), F.col("user_id").cast("string"))
    return parquet(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(I.without_nulls(entries)), ",").alias("names"))


_LATEST = "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"


def _latest_order(table: VersionedTable) -> DataFrame:
    return table.read().select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("versioned_latest", _LATEST)
def versioned_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of each customer, from a versioned table that the orders were merged into in two commits."""
    o = parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    table = VersionedTable(spark, storage.new_folder(spark, "versions"), ["o_custkey"], ["o_orderdate", "o_orderkey"], buckets=16)
    for part in (0, 1):
        table.merge(o.where(F.col("o_orderkey") % 2 == part))
    return _latest_order(table)


@query("stream_latest", _LATEST)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the orders read as a stream, each batch one commit."""
    target, order = storage.new_folder(spark, "versions"), ["o_orderdate", "o_orderkey"]
    o = W.read_stream(spark, f"{sf_dir}/orders.parquet").select("o_custkey", *order, "o_totalprice")
    W.latest_per_key(o, target, ["o_custkey"], order, storage.new_folder(spark, "state")).awaitTermination()
    return _latest_order(VersionedTable(spark, target, ["o_custkey"]))


# ------------------------------------------------------------------ captures of drifting shape

#: Where a capture holds what is wanted: three shapes of one record.
_FIELDS: V.Fields = {
    "id": ("bigint", ["$.id"], None),
    "role": ("string", ["$.attributes.speaker.data.attributes.name", "$.attributes.speaker.name", "$.attributes.speaker"], None),
    "length": ("bigint", ["$.attributes.length"], -1),
}


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON, a third in each of three shapes; some of the second lose their last character."""
    t = parquet(spark, sf_dir, "conversations")
    nested = lambda c, *names: nested(F.struct(c.alias(names[-1])), *names[:-1]) if names else c
    split = F.split("text", "\n").alias("lines")
    shapes = (
        F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(nested(F.col("role"), "data", "attributes", "name").alias("speaker"), split).alias("attributes"))),
        F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.struct(nested(F.col("role"), "name").alias("speaker"), F.length("text").alias("length"), split).alias("attributes"))),
        F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(F.col("role").alias("speaker"), F.col("text").alias("body")).alias("attributes"))),
    )
    shape = F.col("turn") % 3
    whole = F.when(shape == 0, shapes[0]).when(shape == 1, shapes[1]).otherwise(shapes[2])
    cut = F.when((shape == 1) & (F.col("conv_id") % 5 == 2), F.expr("left(capture, length(capture) - 1)")).otherwise(F.col("capture"))
    return V.parsed(t.select("conv_id", "turn", whole.alias("capture")).withColumn("capture", cut), "capture")


_CUT = "(turn % 3 = 1 AND conv_id % 5 = 2)"


@query("captures_typed", f"SELECT conv_id, turn, NOT {_CUT} AS valid, CASE WHEN NOT {_CUT} THEN conv_id END AS id, CASE WHEN NOT {_CUT} THEN role END AS role, CASE WHEN turn % 3 = 1 AND NOT {_CUT} AND text IS NOT NULL THEN length(text) ELSE -1 END AS length FROM conversations")
def captures_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested captures of three shapes, read without a schema; what is no JSON is marked."""
    return V.typed(_captured(spark, sf_dir), _FIELDS).select("conv_id", "turn", "valid", "id", "role", "length")


@query("captures_lines", f"SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE turn % 3 < 2 AND NOT {_CUT})")
def captures_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the captures' nested arrays as rows."""
    return V.elements(_captured(spark, sf_dir), "$.attributes.lines").select("conv_id", "turn", "pos", F.col("value").cast("string").alias("line"))
