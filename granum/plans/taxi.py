"""Trip analytics: data quality, demand, revenue by zone, payment mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granum.operators import profiling as P
from granum.plans.registry import query
from granum.sources.tables import parquet


@query("hourly_demand", "SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, count(*) AS num_trips FROM events WHERE value > 0 GROUP BY 1")
def hourly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of day."""
    return parquet(spark, sf_dir, "events").where("value > 0").groupBy(F.hour("ts").alias("hour_of_day")).agg(F.count("*").alias("num_trips"))


@query(
    "weekly_demand",
    """SELECT dayname(ts) AS day_name, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, count(*) AS num_trips, round(avg(value), 2) AS avg_fare
       FROM events GROUP BY 1, 2""",
)
def weekly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and mean value by weekday; 1 is Sunday."""
    return (
        parquet(spark, sf_dir, "events").groupBy(F.date_format("ts", "EEEE").alias("day_name"), F.dayofweek("ts").alias("dow"))
        .agg(F.count("*").alias("num_trips"), F.round(F.avg("value"), 2).alias("avg_fare"))
    )


@query(
    "revenue_by_zone",
    """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS num_orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_revenue
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def revenue_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, revenue and mean revenue by nation; unmatched rows keep a null zone.

    Orders are first added up by customer on the map side, so the joins see one row for
    each customer instead of each order.
    """
    t = lambda n: parquet(spark, sf_dir, n)
    zones = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    zoned = t("customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")
    spent = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    total = F.sum("total").cast("double")
    return (
        spent.join(zoned, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("r_name", "n_name")
        .agg(F.sum("n").alias("num_orders"), total.alias("total_revenue"), F.round(total / F.sum("n"), 4).alias("avg_revenue"))
    )


@query(
    "payment_mix",
    """SELECT CASE event_type WHEN 'purchase' THEN 'card' WHEN 'click' THEN 'cash' WHEN 'view' THEN 'no charge' WHEN 'error' THEN 'dispute' ELSE 'other' END AS payment,
              count(*) AS num_trips, round(avg(value), 4) AS avg_total, round(avg(value * value), 2) AS avg_square
       FROM events GROUP BY 1""",
)
def payment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and means by payment label; the label follows from the grouping key."""
    by = parquet(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("num_trips"), F.avg("value").alias("a"), F.avg(F.col("value") * F.col("value")).alias("b"))
    e = F.col("event_type")
    label = F.when(e == "purchase", "card").when(e == "click", "cash").when(e == "view", "no charge").when(e == "error", "dispute").otherwise("other")
    return by.groupBy(label.alias("payment")).agg(
        F.sum("num_trips").alias("num_trips"),
        F.round(F.sum(F.col("a") * F.col("num_trips")) / F.sum("num_trips"), 4).alias("avg_total"),
        F.round(F.sum(F.col("b") * F.col("num_trips")) / F.sum("num_trips"), 2).alias("avg_square"),
    )


_NULLABLE = "SELECT *, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem"


def _nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").withColumns({"discount": F.nullif("l_discount", F.lit(0.0)), "tax": F.nullif("l_tax", F.lit(0.0))})


@query(
    "dq_rule_counts",
    f"""SELECT CAST(count(*) FILTER (WHERE l_quantity <= 1) AS BIGINT) AS tiny_quantity, CAST(count(*) FILTER (WHERE l_quantity > 40) AS BIGINT) AS big_quantity,
               CAST(count(*) FILTER (WHERE l_extendedprice <= 1000) AS BIGINT) AS cheap, CAST(count(*) FILTER (WHERE l_extendedprice > 50000) AS BIGINT) AS dear,
               CAST(count(*) FILTER (WHERE discount > 0.05) AS BIGINT) AS discounted FROM ({_NULLABLE})""",
)
def dq_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules counted in one pass."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return P.rule_counts(_nullable(spark, sf_dir), {"tiny_quantity": q <= 1, "big_quantity": q > 40, "cheap": p <= 1000, "dear": p > 50000, "discounted": F.col("discount") > 0.05})


@query("dq_null_counts", f"SELECT count(*) - count(discount) AS discount, count(*) - count(tax) AS tax, count(*) - count(l_quantity) AS l_quantity FROM ({_NULLABLE})")
def dq_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of three columns in one pass."""
    return P.null_counts(_nullable(spark, sf_dir), ["discount", "tax", "l_quantity"])


_KEEP = "l_quantity > 0 AND l_quantity <= 45 AND l_extendedprice > 0 AND l_extendedprice <= 60000 AND discount > 0"


@query(
    "dq_clean_report",
    f"SELECT count(*) AS n_before, count(*) FILTER (WHERE {_KEEP}) AS n_after, round(100.0 * (count(*) - count(*) FILTER (WHERE {_KEEP})) / CAST(count(*) AS DOUBLE), 4) AS removed_pct FROM ({_NULLABLE})",
)
def dq_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-predicate filter, before and after; nulls fail it."""
    return P.clean_report(_nullable(spark, sf_dir), F.expr(_KEEP))


@query(
    "scan_parquet_profile",
    """SELECT 'lineitem' AS table_name, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem UNION ALL SELECT 'orders', count(*), 6 FROM orders
       UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'events', count(*), 6 FROM events""",
)
def scan_parquet_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the main tables; counts come from Parquet metadata."""
    out = None
    for name in ("lineitem", "orders", "customer", "events"):
        df = parquet(spark, sf_dir, name)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def _describe_sql(table: str, columns: list[str]) -> str:
    q = lambda c, p: f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, {q(c, .25)} AS q25, {q(c, .5)} AS q50, {q(c, .75)} AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}"
        for c in columns
    )


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", _describe_sql("lineitem", _NUM))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the numeric line columns."""
    return P.describe(parquet(spark, sf_dir, "lineitem"), _NUM)


@query(
    "missing_report",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 2) AS pct_missing FROM ({_NULLABLE})" for c in ("discount", "tax", "l_shipdate", "l_linestatus")),
)
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of four columns."""
    return P.missing_report(_nullable(spark, sf_dir), ["discount", "tax", "l_shipdate", "l_linestatus"])


@query(
    "constant_columns",
    "SELECT column_name, CAST(1 AS BIGINT) AS n_distinct FROM (SELECT 'one' AS column_name, count(DISTINCT 1) AS n FROM customer UNION ALL SELECT 'null_or_a', count(DISTINCT CASE WHEN c_acctbal > 0 THEN 'a' END) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) WHERE n = 1",
)
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with a single value, nulls aside."""
    df = parquet(spark, sf_dir, "customer").select("c_mktsegment", F.lit(1).alias("one"), F.when(F.col("c_acctbal") > 0, "a").alias("null_or_a"))
    return P.constant_columns(df, ["one", "null_or_a", "c_mktsegment"])
