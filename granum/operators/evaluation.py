"""Retrieval and answer evaluation: content matching, ranking metrics, agreement, significance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granum.operators.sizes import broadcast_if_small

# Verbal bands of kappa, from the top.
BANDS = [(0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight")]


def _grams(x: Column, n: int) -> Column:
    """``n``-word runs of a text (shorter ones at its end), hashed."""
    words = F.split(x, " ")
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(runs, lambda g: F.xxhash64(g))


def content_match(docs: DataFrame, windows: DataFrame, n: int = 4) -> DataFrame:
    """Distinct ``gold, id`` where a window of the gold passage occurs in the document.

    ``docs`` has ``id, body`` and ``windows`` has ``gold, window``, both with single
    spaces.  A window with ``n`` whole words inside meets documents by the hash of its
    first such run and is then verified.  Shorter ones are sought all at once in one
    map-only pass, by automata over at most ``SHORT`` windows each.  Empty windows match nothing.
    """
    inner = windows.where("window <> ''").withColumn("_w", F.split("window", " ")).withColumn("_in", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(1))))
    long = inner.where(F.size("_w") >= n + 2).select("gold", "window", F.xxhash64(F.array_join(F.slice("_in", 1, n), " ")).alias("h"))
    # runs travel without bodies, which then meet only the windows that share a run with them
    seen = docs.select("id", F.explode(F.array_distinct(_grams(F.col("body"), n))).alias("h"))
    maybe = seen.join(broadcast_if_small(long), "h").select("id", "gold", "window").distinct()
    every = docs.join(maybe, "id").where(F.contains("body", F.col("window"))).select("gold", "id")
    held: dict[str, list] = {}
    for gold, window in inner.where(F.size("_w") < n + 2).select("gold", "window").toLocalIterator():
        held.setdefault(window, []).append(gold)
        if len(held) >= SHORT:
            every = every.unionByName(_short_matches(docs, held, windows))
            held = {}
    if held:
        every = every.unionByName(_short_matches(docs, held, windows))
    return every.distinct()


#: Short windows of one automaton.
SHORT = 100_000


def _short_matches(docs: DataFrame, held: dict[str, list], windows: DataFrame) -> DataFrame:
    """``gold, id`` of the windows that occur in each document, found in one pass over its body."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([windows.schema["gold"], docs.schema["id"]])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for window, golds in shared.value.items():
            found.add_word(window, golds)
        found.make_automaton()
        for batch in batches:
            pairs = [(g, i) for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if body for g in {g for _, golds in found.iter(body) for g in golds}]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kinds[k]) for k in (0, 1)], names=["gold", "id"])

    return docs.select("id", "body").mapInArrow(scan, schema)


def ir_metrics(run: DataFrame, gold: DataFrame, match: DataFrame, k: int) -> DataFrame:
    """Per query: ``hit, recall, mrr`` at ``k``; ``gold`` has ``qid, gold``, each counted once."""
    found = run.where(F.col("rank") <= k).join(match, "id").join(gold, ["qid", "gold"])
    per = found.groupBy("qid").agg(F.count_distinct("gold").alias("n_found"), F.min("rank").alias("first_rank"))
    total = gold.groupBy("qid").agg(F.count_distinct("gold").alias("n_gold"))
    return total.join(per, "qid", "left").select(
        "qid", F.when(F.col("n_found") > 0, 1).otherwise(0).alias("hit"),
        F.round(F.coalesce(F.col("n_found"), F.lit(0)) / F.col("n_gold"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"),
    )


def mcnemar(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """``b, c, p`` of the exact two-sided test on discordant pairs; none gives 1."""
    one = pairs.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    n, m = F.col("b") + F.col("c"), F.least("b", "c")
    step = lambda s, i: F.when(i == 0, s["log"]).otherwise(s["log"] + F.log(n - i + 1) - F.log(i.cast("double")))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), m.cast("int")), start, lambda s, i: F.struct(step(s, i).alias("log"), (s["sum"] + F.exp(step(s, i))).alias("sum")), lambda s: s["sum"])
    return one.withColumn("p", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6)))


def kappa(pairs: DataFrame, a: str, b: str, skip: str = "unsure") -> DataFrame:
    """``n, observed, expected, kappa, band`` of two raters; rows with ``skip`` or null are left out."""
    counts = pairs.where((F.col(a) != skip) & (F.col(b) != skip)).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    cells = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"))
    rows, cols = counts.groupBy("x").agg(F.sum("n").alias("r")), counts.groupBy("y").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("s"))
    po, pe = F.col("agree") / F.col("n"), F.col("s") / (F.col("n") * F.col("n"))
    k = F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe))
    band = F.lit("below chance")
    for least, name in reversed(BANDS):
        band = F.when(k >= least, name).otherwise(band)
    return cells.join(F.broadcast(chance)).select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(k, 6).alias("kappa"), band.alias("band"))


def citations(answer: Column, n_given: Column) -> Column:
    """``struct(cited, invalid)`` numbers of an answer's ``[n]`` marks, distinct and sorted."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda v: v.cast("int"))))
    return F.struct(cited.alias("cited"), F.filter(cited, lambda v: (v < 1) | (v > n_given)).alias("invalid"))


def cited_texts(cited: Column, given: Column) -> Column:
    """The excerpt behind each valid citation number, in order."""
    return F.transform(F.filter(cited, lambda n: (n >= 1) & (n <= F.size(given))), lambda n: F.get(given, n - 1))


def citation_precision(cited: Column, given: Column, windows: Column) -> Column:
    """Share of the validly cited excerpts that hold any gold window; null without gold or a valid citation."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    texts = cited_texts(cited, given)
    good = F.filter(texts, lambda t: F.exists(windows, lambda w: F.contains(flat(t), flat(w))))
    return F.when((F.size(windows) > 0) & (F.size(texts) > 0), F.size(good) / F.size(texts))


def named(text: Column, names: dict[str, list[str]]) -> Column:
    """Keys whose names occur in a text, letter case aside; all keys if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(n.lower()) for n in ns]), lambda n: F.contains(low, n)), F.lit(k)) for k, ns in names.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, names)))
