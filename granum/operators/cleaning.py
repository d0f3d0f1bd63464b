"""The review cleaner with lemmas, as joins of the vocabulary with a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum import storage
from granum.functions.text import NOUN_ENDINGS, clean_words
from granum.operators.sizes import broadcast_if_small


def changed_words(words: DataFrame, lexicon: DataFrame, exceptions: dict[str, str] | None = None) -> DataFrame:
    """``word, lemma`` of those distinct ``word`` of ``words`` that are not their own lemma.

    A lemma is the exception's, else the shortest of the forms in ``lexicon`` (column
    ``word``): the word itself, or with one ending of a plural replaced; of equally short
    forms the word itself, then the earlier ending.  A word without a known form is its own
    lemma.  Null words take no part, in either table.
    """
    w = F.col("word")
    forms = [F.struct(F.length(w).alias("n"), F.lit(0).alias("at"), w.alias("form"))]
    for i, (end, new) in enumerate(NOUN_ENDINGS, 1):
        stem = F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(new))
        fits = w.endswith(end) & ~w.endswith("ss") if end == "s" else w.endswith(end)
        forms.append(F.when(fits, F.struct(F.length(stem).alias("n"), F.lit(i).alias("at"), stem.alias("form"))))
    every = words.select("word").where("word is not null").distinct()
    tried = every.select("word", F.explode(F.array_compact(F.array(*forms))).alias("f"))
    known = lexicon.select(F.col("word").alias("known")).distinct()
    held = tried.join(known, F.col("f.form") == F.col("known"), "left_semi")
    if exceptions:
        odd = words.sparkSession.createDataFrame(list(exceptions.items()), "word string, lemma string")
        held = held.unionByName(every.join(F.broadcast(odd), "word").select("word", F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("at"), F.col("lemma").alias("form")).alias("f")))
    return held.groupBy("word").agg(F.min("f").alias("f")).select("word", F.col("f.form").alias("lemma")).where("word <> lemma")


def lemmatised(df: DataFrame, key: str, words: str, changed: DataFrame) -> DataFrame:
    """``df`` with each word of the array ``words`` as its lemma, by the pairs of :func:`changed_words`.

    Only the distinct changed words of a row are dealt out, as one map for each ``key``; rows of
    one key share it, as a word has one lemma.  Null arrays stay null, null keys are a key.
    """
    pairs = df.select(F.col(f"`{key}`").alias("lemma_key"), F.explode(F.array_distinct(F.col(f"`{words}`"))).alias("word"))
    met = pairs.join(broadcast_if_small(changed), "word").groupBy("lemma_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("lemma_of"))
    out = df.join(met, F.col(f"`{key}`").eqNullSafe(F.col("lemma_key")), "left")
    each = F.transform(F.col(f"`{words}`"), lambda w: F.coalesce(F.try_element_at("lemma_of", w), w))
    return out.select(*[F.when(F.col("lemma_of").isNull(), F.col(f"`{c}`")).otherwise(each).alias(c) if c == words else F.col(f"`{c}`") for c in df.columns])


def clean_text(df: DataFrame, key: str, text: str, lexicon: DataFrame | None = None, exceptions: dict[str, str] | None = None) -> DataFrame:
    """``key, clean``: letters only, lower case, no stop words, over two letters, as lemmas of ``lexicon``.

    Without a lexicon it is the table's own cleaned words, so a plural becomes the singular
    that some row holds.  A null or empty text is an empty one.
    """
    spark = df.sparkSession
    path, pairs = storage.new_folder(spark, "cleaned"), storage.new_folder(spark, "lemmas")
    df.select(F.col(f"`{key}`").alias(key), clean_words(F.col(f"`{text}`")).alias("clean")).write.parquet(path)  # patterns run over each text once
    cleaned = spark.read.parquet(path)
    vocabulary = cleaned.select(F.explode("clean").alias("word")).distinct()
    changed_words(vocabulary, vocabulary if lexicon is None else lexicon, exceptions).write.parquet(pairs)
    return lemmatised(cleaned, key, "clean", spark.read.parquet(pairs)).select(f"`{key}`", F.array_join("clean", " ").alias("clean"))
