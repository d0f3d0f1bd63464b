"""URL filter: host and path rules, then a character language-model ratio.

URLs that a rule allows and URLs that a rule blocks are the accepted and rejected
samples.  One smoothed variable-order Markov model is counted for each over a fixed
alphabet: a character is predicted from the two before it, backing off to one and to
none where a context was never seen (Witten-Bell weights, add-one at order zero).  The
score of a URL is the log-likelihood difference divided by its length; the threshold
maximises balanced accuracy on a held-out fifth of the rule-labelled URLs.  All of it is
DataFrame expressions: the two models become one array of ``SYMBOLS ** 3`` ratios, a size
that does not depend on the data, so scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granum.llm.common import free_name

# The characters the models tell apart; every digit counts as 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-:?=&#_%"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Other characters are symbol 0, then the alphabet, then the start and the end of a URL.
START, END = len(ALPHABET) + 1, len(ALPHABET) + 2
SYMBOLS = len(ALPHABET) + 3
#: Rules are compiled into the plan, so their number is bounded.
MAX_RULES = 1000
#: Scores are calibrated in steps of 1/100 nat per character between -10 and 10.
STEPS, REACH = 100, 10

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (nulls if none fits).

    ``rules`` are ``(verdict, "host/path")`` pairs.  A rule fits its host and all
    subdomains where the path starts with the rule's; of equally long ones the first
    given wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        top, slash, below = text.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(slash + below))
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def trigrams(url: Column) -> Column:
    """The trigram numbers of a URL, one for each character and one for its end."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "000000000")
    codes = F.transform(F.split(plain, ""), lambda c: F.when(c == "", 0).otherwise(F.position(c, F.lit(ALPHABET))))
    codes = F.when(F.length(plain) > 0, codes).otherwise(F.array().cast("array<int>"))
    seq = F.concat(F.array(F.lit(START), F.lit(START)), codes, F.array(F.lit(END)))
    grams = F.zip_with(F.zip_with(F.slice(seq, 1, F.length(plain) + 1), F.slice(seq, 2, F.length(plain) + 1), lambda a, b: a * SYMBOLS + b), F.slice(seq, 3, F.length(plain) + 1), lambda ab, c: ab * SYMBOLS + c)
    return grams


def ratio_model(labelled: DataFrame, grams: str, accepted: str) -> DataFrame:
    """One row with ``ratios``: ln P(accepted) - ln P(rejected) of each trigram, by number.

    ``labelled`` has an array column of trigram numbers and a boolean.  With no rows of
    a class, its model is the uniform one.
    """
    spark = labelled.sparkSession
    counts = (
        labelled.select(F.explode(grams).alias("g"), F.col(accepted).alias("y"))
        .groupBy("g").agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"))
    )
    g = F.col("g")
    dense = (
        spark.range(SYMBOLS**3).select(F.col("id").cast("int").alias("g")).join(counts, "g", "left").fillna(0, ["n1", "n0"])
        .select("g", "n1", "n0", F.floor(g / SYMBOLS**2).alias("a"), F.floor(g / SYMBOLS).cast("int").alias("ab"), (F.floor(g / SYMBOLS) % SYMBOLS).alias("b"), (g % SYMBOLS).alias("c"))
    )
    total, by_c, by_b = Window.partitionBy(), Window.partitionBy("c"), Window.partitionBy("b")
    by_bc, by_ab = Window.partitionBy("b", "c"), Window.partitionBy("ab")
    logs = []
    for k in ("n1", "n0"):
        n = F.col(k)
        dense = dense.withColumn(f"bc_{k}", F.sum(n).over(by_bc))
        p0 = (F.sum(n).over(by_c) + 1) / (F.sum(n).over(total) + SYMBOLS)
        seen1 = F.count_if(F.col(f"bc_{k}") > 0).over(by_b) / SYMBOLS
        all1 = F.sum(n).over(by_b)
        p1 = F.when(all1 > 0, (F.col(f"bc_{k}") + seen1 * p0) / (all1 + seen1)).otherwise(p0)
        seen2, all2 = F.count_if(n > 0).over(by_ab), F.sum(n).over(by_ab)
        dense = dense.withColumn(f"p1_{k}", p1).withColumn(f"s2_{k}", seen2).withColumn(f"a2_{k}", all2)
        p1 = F.col(f"p1_{k}")
        logs.append(F.log(F.when(F.col(f"a2_{k}") > 0, (n + F.col(f"s2_{k}") * p1) / (F.col(f"a2_{k}") + F.col(f"s2_{k}"))).otherwise(p1)))
    return dense.select("g", (logs[0] - logs[1]).alias("r")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("ratios")
    )


def scored(urls: DataFrame, model: DataFrame, grams: str, out: str) -> DataFrame:
    """``urls`` with the mean ratio of its trigrams in column ``out``."""
    ratios = free_name(urls, "ratios")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, t: acc + F.get(F.col(ratios), t))
    return urls.join(F.broadcast(model.select(F.col("ratios").alias(ratios)))).withColumn(out, total / F.size(grams)).drop(ratios)


def threshold(held: DataFrame, score: str, accepted: str) -> DataFrame:
    """One row with ``cut``: the score that separates best; 0 where a class is absent.

    It lies midway between the steps that it parts, which leaves the widest margin.
    """
    step = F.floor(F.least(F.greatest(F.col(score), F.lit(-REACH)), F.lit(REACH)) * STEPS).cast("int")
    bins = held.groupBy(step.alias("s")).agg(F.count_if(accepted).alias("pos"), F.count_if(~F.col(accepted)).alias("neg"))
    below = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gain = F.coalesce(F.sum("neg").over(below), F.lit(0)) / F.sum("neg").over(every) - F.coalesce(F.sum("pos").over(below), F.lit(0)) / F.sum("pos").over(every)
    before = F.coalesce(F.lag("s").over(Window.partitionBy().orderBy("s")) + 1, F.col("s"))
    ranked = bins.select("s", gain.alias("gain"), ((F.col("s") + before) / (2.0 * STEPS)).alias("mid"))
    best = F.max_by("mid", F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("s"))))
    return ranked.agg(F.coalesce(best, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``.

    ``verdict`` is the rule's, else the model's: ``allow`` at or above the calibrated
    threshold, else ``block``.  Null and empty URLs have empty host and path and are
    scored as an empty string; with no rule-labelled URL of a class the threshold is 0.
    Repeated rows count once each; columns of ``pages`` with these names are replaced.
    """
    names = ("host", "path", "rule", "verdict", "score")
    src = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names])
    keep = src.columns
    grams, by_rule = free_name(src, "grams"), free_name(src, "by_rule")
    host, path = host_and_path(F.col(url_col))
    src = src.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": name, by_rule: verdict})
    coded = src.withColumn(grams, trigrams(F.col(url_col)))

    labelled = coded.where(F.col(by_rule).isNotNull()).select(grams, (F.col(by_rule) == "allow").alias("y"), (F.pmod(F.xxhash64(url_col), F.lit(5)) == 0).alias("held"))
    model = ratio_model(labelled.where("not held"), grams, "y")
    cut = threshold(scored(labelled.where("held"), model, grams, "score"), "score", "y")
    at = free_name(src, "cut")
    judged = scored(coded, model, grams, "score").join(F.broadcast(cut.select(F.col("cut").alias(at))))
    return judged.withColumn("verdict", F.coalesce(F.col(by_rule), F.when(F.col("score") >= F.col(at), "allow").otherwise("block"))).select(
        *[F.col(f"`{c}`") for c in keep], *names
    )


# The rules of the production query.
RULES: list[Rule] = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def report(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``, and the model's ``score``."""
    return judge(pages.select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
