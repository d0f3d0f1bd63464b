"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of adjacent lines is taken at every line and counted over
the corpus.  It alone sets the boundaries: a chunk starts and ends where the rolling hash
stops recurring, or where the place that it first occurred at stops moving along.  So a
chunk is a maximal run of two or more lines that follows one earlier run, wherever either
begins and whatever surrounds it, and inserted lines shift no boundary behind them.  Each
chunk is then compared with its first occurrence byte by byte, and the lines that agree
(each with a neighbour at least) are removed; the first occurrence (by ``doc_id``, then
text hash, then line) stays, as do lines of a run that overlaps its own first occurrence.

Rolling hashes are counted with map-side combine, runs of places are put together from
sorted arrays of one document each, and only texts that give or take part in a chunk are
dealt out.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import bitmap, bitmap_has, discard, free_name, materialize

#: Lines under a rolling hash.
WINDOW = 2


def _rolling() -> Column:
    """The rolling hash at each line of column ``marks`` but the last; null over white space only."""
    ahead = F.slice("marks", 2, F.size("marks") - 1)
    return F.zip_with(F.slice("marks", 1, F.size("marks") - 1), ahead, lambda a, b: F.when(a["full"] | b["full"], F.xxhash64(a["h"], b["h"])))


def _islands(places: Column) -> Column:
    """``(first, last)`` of the runs of consecutive numbers in a sorted array of distinct ones."""
    firsts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) < x - 1))
    lasts = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > x + 1))
    return F.arrays_zip(firsts.alias("first"), lasts.alias("last"))


def _chunks(base: DataFrame, id_col: str, text_col: str, dk: str, ek: str) -> DataFrame:
    """Chunks that recur: ``dk, ek, s, n`` and the place ``fdk, fek, fs`` of the first occurrence.

    ``s`` and ``fs`` are line numbers from 0, ``n`` counts lines.
    """
    lines = base.select(F.col(id_col).alias("id"), F.col(dk).alias("dk"), F.col(ek).alias("ek"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    marks = lines.where(F.size("lines") >= WINDOW).select("id", "dk", "ek", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.rlike(x, F.lit("\\S")).alias("full"))).alias("marks"))
    # the outer form hashes once: an inner one is first asked for its size
    found = marks.select("id", "dk", "ek", F.posexplode_outer(_rolling()).alias("s", "r")).where("r is not null")
    place = F.struct(F.col("id").isNotNull().alias("k"), "id", "dk", "ek", "s")
    repeated = found.groupBy("r").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("dk") == F.col("first.dk")) & (F.col("ek") == F.col("first.ek"))
    later = found.join(repeated, "r").where(~(own & (F.col("s") < F.col("first.s") + WINDOW)))
    ahead = (F.col("s") - F.col("first.s")).alias("ahead")
    runs = later.groupBy("dk", "ek", F.col("first.dk").alias("fdk"), F.col("first.ek").alias("fek"), ahead).agg(F.array_sort(F.collect_set("s")).alias("places"))
    one = runs.select("dk", "ek", "fdk", "fek", "ahead", F.explode_outer(_islands(F.col("places"))).alias("run"))
    return one.select("dk", "ek", F.col("run.first").alias("s"), (F.col("run.last") - F.col("run.first") + WINDOW).alias("n"), "fdk", "fek", (F.col("run.first") - F.col("ahead")).alias("fs"))


def _agreeing(part: str, source: str) -> Column:
    """Numbers of the lines that agree in two equally long arrays, each with a neighbour that does."""
    every = F.sequence(F.lit(0), F.size(part) - 1)
    same = lambda j: F.get(part, j).eqNullSafe(F.get(source, j))
    inside = lambda j: (j >= 0) & (j < F.size(part)) & same(j)
    return F.when(F.col(part) == F.col(source), every).otherwise(F.filter(every, lambda j: same(j) & (inside(j - 1) | inside(j + 1))))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut from ``text`` and ``n_lines, n_removed`` added.

    Null texts stay null with zero lines; an empty text is one line.  Runs of white space
    only are left alone.  Rows of equal id and text are one document and fare alike; null
    ids come first.  An empty table gives an empty result.  Columns of ``docs`` with the
    added names are replaced.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    keep = base.columns
    dk, ek, ls, left, c_dk, c_ek, cut = (free_name(base, x) for x in ("doc_key", "doc_key2", "lines_", "left_", "cut_key", "cut_key2", "cut_"))
    base = base.withColumn(dk, F.xxhash64(id_col, text_col)).withColumn(ek, F.xxhash64(F.lit(7), id_col, text_col))
    cut_up = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)

    chunks = materialize(_chunks(base, id_col, text_col, dk, ek), "chunks")
    takes = chunks.groupBy("dk", "ek").agg(F.collect_set(F.struct("s", "n", "fdk", "fek", "fs")).alias("takes"))
    gives = chunks.groupBy(F.col("fdk").alias("g_dk"), F.col("fek").alias("g_ek")).agg(F.collect_set(F.struct("fs", "n")).alias("gives"))
    roles = takes.join(gives, (F.col("dk") == F.col("g_dk")) & (F.col("ek") == F.col("g_ek")), "full")
    roles = materialize(roles.select(F.coalesce("dk", "g_dk").alias("r_dk"), F.coalesce("ek", "g_ek").alias("r_ek"), "takes", "gives"), "roles")
    discard(chunks)

    # only texts whose key is in the bitmap of those with a role are dealt out to the joins
    marked = bitmap_has(bitmap(roles, "r_dk"), F.col(dk))
    held, untouched = base.where(marked), base.where(~marked)
    texts = held.select(F.col(dk).alias("dk"), F.col(ek).alias("ek"), F.col(text_col).alias("text")).join(roles, (F.col("dk") == F.col("r_dk")) & (F.col("ek") == F.col("r_ek")))
    texts = texts.select("dk", "ek", F.split("text", "\n", -1).alias("lines"), "takes", "gives")
    taken = texts.select("dk", "ek", "lines", F.explode("takes").alias("t")).select("dk", "ek", "t.*", F.slice("lines", F.col("t.s") + 1, F.col("t.n")).alias("part"))
    given = texts.select(F.col("dk").alias("fdk"), F.col("ek").alias("fek"), "lines", F.explode("gives").alias("g")).select("fdk", "fek", "g.*", F.slice("lines", F.col("g.fs") + 1, F.col("g.n")).alias("source"))
    given = given.dropDuplicates(["fdk", "fek", "fs", "n"])
    met = taken.join(given, ["fdk", "fek", "fs", "n"])
    lost = met.select("dk", "ek", F.transform(_agreeing("part", "source"), lambda j: j + F.col("s")).alias("gone"))
    cuts = lost.groupBy(F.col("dk").alias(c_dk), F.col("ek").alias(c_ek)).agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias(cut))

    out = held.join(cuts, (F.col(dk) == F.col(c_dk)) & (F.col(ek) == F.col(c_ek)), "left").withColumn(ls, cut_up)
    stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(cut))
    out = out.withColumn(left, F.when(F.size(cut) > 0, F.transform(stay, lambda i: F.get(ls, i))))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(ls))
    plain = untouched.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col(text_col).isNull(), 0).otherwise(F.size(cut_up)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"))
    return plain.unionByName(out.select(
        *[F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col(left).isNotNull(), F.size(ls) - F.size(left)).otherwise(0).cast("bigint").alias("n_removed"),
    ))


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_removed, text`` (what is left of it)."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
