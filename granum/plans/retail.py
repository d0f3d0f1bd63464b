"""Retail analytics: cleaning, revenue, Pareto, RFM, lifetime value, campaign return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granum.functions.money import dsum, share
from granum.operators import customers as C
from granum.operators import profiling as P
from granum.plans.registry import query
from granum.sources.tables import parquet

_D = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
_SALES = """(SELECT l_orderkey, o_custkey, o_orderdate, l_quantity, l_extendedprice, p_type, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag <> 'R')"""
#: First and last whole revenue rows: (customer, revenue).
_REV = f"(SELECT o_custkey, {_D('o_totalprice')} AS revenue FROM orders GROUP BY 1)"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines not returned, with order, customer, product type and country."""
    t = lambda n: parquet(spark, sf_dir, n)
    buyers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return (
        t("lineitem").where("l_returnflag <> 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select("l_orderkey", "o_custkey", "o_orderdate", "l_quantity", "l_extendedprice", "p_type", "n_name")
    )


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each customer."""
    return parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(dsum("o_totalprice").alias("revenue"))


@query(
    "retail_clean",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_returnflag = 'R') AS n_cancelled,
              count(*) FILTER (WHERE l_returnflag <> 'R' AND cust IS NULL) AS n_no_customer,
              count(*) FILTER (WHERE l_returnflag <> 'R' AND cust IS NOT NULL AND l_quantity <= 2) AS n_bad_quantity,
              count(*) FILTER (WHERE l_returnflag <> 'R' AND cust IS NOT NULL AND l_extendedprice <= 2000) AS n_bad_price,
              count(*) FILTER (WHERE l_returnflag <> 'R' AND cust IS NOT NULL AND l_quantity > 2 AND l_extendedprice > 2000) AS n_kept
       FROM (SELECT *, nullif(l_suppkey % 10, 0) AS cust FROM lineitem)""",
)
def retail_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascading cleaning rules counted in one pass, each under the rules before it."""
    df = parquet(spark, sf_dir, "lineitem").withColumn("cust", F.expr("nullif(l_suppkey % 10, 0)"))
    live = F.col("l_returnflag") != "R"
    known = live & F.col("cust").isNotNull()
    q, p = F.col("l_quantity") <= 2, F.col("l_extendedprice") <= 2000
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(~live).alias("n_cancelled"), F.count_if(live & F.col("cust").isNull()).alias("n_no_customer"),
        F.count_if(known & q).alias("n_bad_quantity"), F.count_if(known & p).alias("n_bad_price"), F.count_if(known & ~q & ~p).alias("n_kept"),
    )


@query(
    "aov_arpc",
    f"""SELECT round((SELECT avg(t) FROM (SELECT {_D('o_totalprice')} AS t FROM orders GROUP BY o_orderkey)), 4) AS avg_order_value,
               round((SELECT avg(revenue) FROM {_REV}), 4) AS avg_revenue_per_customer""",
)
def aov_arpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue of an order and of a customer, from one pass by both keys."""
    by = parquet(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderkey").agg(dsum("o_totalprice").alias("t")).groupBy("o_custkey").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("t") / F.sum("n"), 4).alias("avg_order_value"), F.round(F.avg("t"), 4).alias("avg_revenue_per_customer"))


@query(
    "country_revenue",
    f"""SELECT *, round(100.0 * revenue / sum(revenue) OVER (), 4) AS share_of_top FROM (
          SELECT n_name, {_D('l_extendedprice')} AS revenue, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_orderkey) AS orders
          FROM {_SALES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
)
def country_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best countries, with their share of the ten."""
    top = (
        sales(spark, sf_dir).groupBy("n_name", "o_custkey", "l_orderkey").agg(dsum("l_extendedprice").alias("r"))
        .groupBy("n_name", "o_custkey").agg(F.sum("r").alias("r"), F.count("*").alias("k"))
        .groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("customers"), F.sum("k").alias("orders"))
        .orderBy(F.desc("revenue"), "n_name").limit(10)
    )
    return top.withColumn("share_of_top", share(F.col("revenue"), F.sum("revenue").over(Window.partitionBy())))


@query(
    "monthly_sales",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {_D('o_totalprice')} AS revenue, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY 1""",
)
def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, orders and customers by month; keys are deduplicated before counting."""
    return (
        parquet(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey", "o_orderkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("r"))
        .groupBy("month", "o_custkey").agg(F.sum("r").alias("r"), F.count("*").alias("k"))
        .groupBy("month").agg(F.sum("r").cast("double").alias("revenue"), F.sum("k").alias("orders"), F.count("*").alias("customers"))
    )


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query(
    "sales_by_dow_hour",
    "SELECT day_pos, day_name, hour_of_day, coalesce(revenue, 0) AS revenue FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS day_pos, unnest(['"
    + "','".join(_DAYS)
    + """']) AS day_name) CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour_of_day)
       LEFT JOIN (SELECT CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS day_pos, CAST(hour(ts) AS INTEGER) AS hour_of_day, round(sum(value), 2) AS revenue FROM events GROUP BY 1, 2) USING (day_pos, hour_of_day)""",
)
def sales_by_dow_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by weekday (Monday first) and hour, absent cells as zero."""
    got = parquet(spark, sf_dir, "events").groupBy(((F.dayofweek("ts") + 5) % 7).alias("day_pos"), F.hour("ts").alias("hour_of_day")).agg(F.round(F.sum("value"), 2).alias("revenue"))
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("day_pos"), (F.col("id") % 24).cast("int").alias("hour_of_day"))
    named = grid.withColumn("day_name", F.element_at(F.array(*map(F.lit, _DAYS)), F.col("day_pos") + 1))
    return named.join(got, ["day_pos", "hour_of_day"], "left").fillna(0.0, ["revenue"])


@query(
    "top_customers",
    f"""WITH r AS {_REV} SELECT o_custkey, revenue, round(100.0 * revenue / (SELECT sum(CAST(revenue AS DECIMAL(18,2))) FROM r), 6) AS share_of_all FROM r ORDER BY revenue DESC, o_custkey LIMIT 15""",
)
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best customers with their share of all revenue."""
    r = revenue(spark, sf_dir)
    total = r.agg(dsum("revenue")).scalar()
    return r.orderBy(F.desc("revenue"), "o_custkey").limit(15).withColumn("share_of_all", F.round(100.0 * F.col("revenue") / total, 6))


@query(
    "pareto_curve",
    f"""SELECT o_custkey, revenue, round(100.0 * sum(CAST(revenue AS DECIMAL(18,2))) OVER w / sum(CAST(revenue AS DECIMAL(18,2))) OVER (), 6) AS cum_revenue_pct,
               round(100.0 * row_number() OVER w / CAST(count(*) OVER () AS DOUBLE), 6) AS cum_customer_pct
        FROM {_REV} WINDOW w AS (ORDER BY revenue DESC, o_custkey)""",
)
def pareto_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running shares of revenue and customers by descending revenue."""
    return C.pareto(revenue(spark, sf_dir), "o_custkey", "revenue").select("o_custkey", "revenue", "cum_revenue_pct", "cum_customer_pct")


@query(
    "pareto_top20",
    f"""SELECT round(100.0 * s / t, 6) AS cum_revenue_pct FROM (SELECT sum(CAST(revenue AS DECIMAL(18,2))) OVER w AS s, sum(CAST(revenue AS DECIMAL(18,2))) OVER () AS t,
          row_number() OVER w AS rn, count(*) OVER () AS n FROM {_REV} WINDOW w AS (ORDER BY revenue DESC, o_custkey)) WHERE rn = CAST(floor(n * 0.2) AS BIGINT) + 1""",
)
def pareto_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue share at position ``int(0.2 n)``, counted from zero."""
    return C.pareto(revenue(spark, sf_dir), "o_custkey", "revenue").where(F.col("pos") == F.floor(F.col("n") * 0.2) + 1).select("cum_revenue_pct")


_RFM = f"""(SELECT o_custkey AS customer, CAST(floor(epoch_us((SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders) - max(o_orderdate)) / 86400000000.0) AS BIGINT) AS recency,
            count(DISTINCT o_orderkey) AS frequency, {_D('o_totalprice')} AS monetary FROM orders GROUP BY 1)"""
_EDGES = lambda c: f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0,.2,.4,.6,.8,1]))) FROM r)"
_BIN = lambda c: f"greatest(1, CAST(len(list_filter({_EDGES(c)}, lambda e: e < {c})) AS INTEGER))"
_NB = lambda c: f"CAST(len({_EDGES(c)}) - 1 AS INTEGER)"
_SCORES = f"""(WITH r AS {_RFM} SELECT *, CAST({_NB('recency')} + 1 - {_BIN('recency')} AS INTEGER) AS r_score, {_BIN('frequency')} AS f_score, {_BIN('monetary')} AS m_score FROM r)"""
_SEG = f"""(SELECT *, CASE WHEN rk <= 0.25 * n THEN 'Champions' WHEN rk <= 0.5 * n THEN 'Loyal' WHEN rk <= 0.75 * n THEN 'At-Risk' ELSE 'Lost' END AS segment FROM (
             SELECT *, r_score + f_score + m_score AS rfm_score, row_number() OVER (ORDER BY r_score + f_score + m_score DESC, monetary DESC, customer) AS rk, count(*) OVER () AS n FROM {_SCORES}))"""


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency and monetary value of each customer."""
    return C.rfm(parquet(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("rfm_table", f"SELECT * FROM {_RFM}")
def rfm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RFM table."""
    return rfm(spark, sf_dir)


@query("rfm_scores", f"SELECT customer, r_score, f_score, m_score, CAST(r_score + f_score + m_score AS INTEGER) AS rfm_score FROM {_SCORES}")
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quintile scores with collapsed edges; the score sums the raw labels."""
    return C.rfm_scores(rfm(spark, sf_dir)).select("customer", "r_score", "f_score", "m_score", "rfm_score")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in four segments by rank of their score."""
    return C.segments(C.rfm_scores(rfm(spark, sf_dir)))


@query("rfm_segments", f"SELECT customer, CAST(rfm_score AS INTEGER) AS rfm_score, segment FROM {_SEG}")
def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment of each customer."""
    return segments(spark, sf_dir).select("customer", "rfm_score", "segment")


@query(
    "segment_summary",
    f"""SELECT segment, count(*) AS customers, round(avg(recency), 1) AS avg_recency, round(avg(frequency), 1) AS avg_frequency, round({_D('monetary')} / count(*), 1) AS avg_monetary,
               {_D('monetary')} AS total, round(100.0 * {_D('monetary')} / sum({_D('monetary')}) OVER (), 1) AS share FROM {_SEG} GROUP BY 1""",
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, means and revenue share of each segment."""
    by = segments(spark, sf_dir).groupBy("segment").agg(
        F.count("*").alias("customers"), F.round(F.avg("recency"), 1).alias("avg_recency"), F.round(F.avg("frequency"), 1).alias("avg_frequency"),
        F.round(dsum("monetary") / F.count("*"), 1).alias("avg_monetary"), dsum("monetary").alias("total"),
    )
    return by.withColumn("share", share(F.col("total"), F.sum("total").over(Window.partitionBy()), 1))


@query(
    "segment_profile_norm",
    f"""SELECT segment, round(1 - (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 6) AS recency, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS frequency,
               round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS monetary
        FROM (SELECT segment, avg(recency) AS a, avg(frequency) AS b, {_D('monetary')} / count(*) AS c FROM {_SEG} GROUP BY 1)""",
)
def segment_profile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment means scaled to [0, 1], recency inverted."""
    by = segments(spark, sf_dir).groupBy("segment").agg(F.avg("recency").alias("a"), F.avg("frequency").alias("b"), (dsum("monetary") / F.count("*")).alias("c"))
    w = Window.partitionBy()
    scaled = lambda x: (F.col(x) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w))
    return by.select("segment", F.round(1 - scaled("a"), 6).alias("recency"), F.round(scaled("b"), 6).alias("frequency"), F.round(scaled("c"), 6).alias("monetary"))


@query(
    "outlier_cap",
    f"""WITH r AS {_RFM} SELECT customer, round(least(monetary, (SELECT quantile_cont(monetary, 0.99) FROM r)), 4) AS capped FROM r""",
)
def outlier_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monetary value capped at its 99th percentile."""
    return P.capped(rfm(spark, sf_dir), "monetary", 0.99, "capped").select("customer", F.round("capped", 4).alias("capped"))


_LTV = f"""(SELECT customer, round(monetary / frequency, 6) AS aov, frequency, round(greatest(days, 365.0 / 12) / 365.0, 6) AS lifespan,
             round(monetary / frequency * (frequency / obs) * (greatest(days, 365.0 / 12) / 365.0), 4) AS ltv FROM (
             SELECT o_custkey AS customer, {_D('o_totalprice')} AS monetary, count(DISTINCT o_orderkey) AS frequency,
                    CAST(floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0) AS DOUBLE) AS days,
                    (SELECT floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0) / 365.0 FROM orders) AS obs FROM orders GROUP BY 1))"""


def ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime value of each customer."""
    return C.lifetime_value(parquet(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("ltv_customer", f"SELECT * FROM {_LTV}")
def ltv_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value, lifespan and lifetime value of each customer."""
    return ltv(spark, sf_dir)


@query(
    "ltv_by_segment",
    f"""SELECT segment, count(*) AS customers, round(avg(ltv), 2) AS mean_ltv, round(median(ltv), 2) AS median_ltv, round(100.0 * sum(ltv) / sum(sum(ltv)) OVER (), 2) AS share
        FROM {_LTV} JOIN (SELECT customer, segment FROM {_SEG}) USING (customer) GROUP BY 1""",
)
def ltv_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime value of each segment, mean, median and share."""
    by = ltv(spark, sf_dir).join(segments(spark, sf_dir).select("customer", "segment"), "customer").groupBy("segment").agg(
        F.count("*").alias("customers"), F.round(F.avg("ltv"), 2).alias("mean_ltv"), F.round(F.median("ltv"), 2).alias("median_ltv"), F.sum("ltv").alias("t")
    )
    return by.withColumn("share", share(F.col("t"), F.sum("t").over(Window.partitionBy()), 2)).drop("t")


@query(
    "revenue_at_risk",
    f"""SELECT count(*) FILTER (WHERE segment = 'At-Risk') AS at_risk_customers, coalesce({_D("CASE WHEN segment = 'At-Risk' THEN monetary END")}, 0) AS at_risk_revenue,
               round(100.0 * {_D("CASE WHEN segment = 'At-Risk' THEN monetary END")} / {_D('monetary')}, 4) AS at_risk_pct,
               round(avg(monetary) FILTER (WHERE segment = 'Champions') / avg(monetary) FILTER (WHERE segment = 'At-Risk'), 4) AS champion_ratio FROM {_SEG}""",
)
def revenue_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of customers at risk, and the worth of a champion against theirs."""
    risk = F.when(F.col("segment") == "At-Risk", F.col("monetary"))
    best = F.when(F.col("segment") == "Champions", F.col("monetary"))
    return segments(spark, sf_dir).agg(
        F.count(risk).alias("at_risk_customers"), F.coalesce(dsum(risk), F.lit(0.0)).alias("at_risk_revenue"),
        F.round(100.0 * dsum(risk) / dsum("monetary"), 4).alias("at_risk_pct"), F.round(F.avg(best) / F.avg(risk), 4).alias("champion_ratio"),
    )


_GRID = f"""(SELECT i, i * CAST(0.05 AS DOUBLE) AS rate, CAST(floor(n * i / 20.0) AS BIGINT) AS converted, round(floor(n * i / 20.0) * m, 2) AS recovered, round(floor(n * i / 20.0) * m - n * 15.0, 2) AS profit
              FROM (SELECT count(*) FILTER (WHERE segment = 'At-Risk') AS n, round(avg(ltv) FILTER (WHERE segment = 'At-Risk'), 4) AS m FROM {_LTV} JOIN (SELECT customer, segment FROM {_SEG}) USING (customer)), (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS i))"""


@query(
    "roi_grid",
    f"SELECT i AS step, round(rate, 2) AS rate, converted, recovered, profit, (SELECT round(min(rate), 2) FROM {_GRID} WHERE profit > 0) AS break_even FROM {_GRID}",
)
def roi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign profit at ten conversion rates, and the first rate that pays."""
    who = ltv(spark, sf_dir).join(segments(spark, sf_dir).select("customer", "segment"), "customer")
    risk = F.when(F.col("segment") == "At-Risk", F.col("ltv"))
    one = who.agg(F.count(risk).alias("n"), F.round(F.avg(risk), 4).alias("m"))
    grid = C.roi_grid(one, "n", "m", cost=15.0)
    paying = F.min(F.when(F.col("profit") > 0, F.col("rate"))).over(Window.partitionBy())
    return grid.withColumn("break_even", paying)


@query(
    "retention_vs_acquisition",
    f"""WITH s AS (SELECT count(*) FILTER (WHERE segment = 'At-Risk') AS n, avg(ltv) FILTER (WHERE segment = 'At-Risk') AS m FROM {_LTV} JOIN (SELECT customer, segment FROM {_SEG}) USING (customer))
        SELECT scenario, CAST(cost AS DOUBLE) AS cost_per_customer, round(m * f, 4) AS value_per_customer, round(m * f / cost, 4) AS value_per_cost
        FROM s, (VALUES ('retain', 15.0, 1.0), ('retain loyal', 7.5, 1.0), ('acquire', 75.0, 0.6)) v(scenario, cost, f)""",
)
def retention_vs_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worth of keeping a customer against winning one."""
    who = ltv(spark, sf_dir).join(segments(spark, sf_dir).select("customer", "segment"), "customer")
    one = who.agg(F.avg(F.when(F.col("segment") == "At-Risk", F.col("ltv"))).alias("m"))
    cases = F.inline(F.array(*[F.struct(F.lit(a).alias("scenario"), F.lit(b).alias("cost_per_customer"), F.lit(c).alias("f")) for a, b, c in (("retain", 15.0, 1.0), ("retain loyal", 7.5, 1.0), ("acquire", 75.0, 0.6))]))
    v = F.col("m") * F.col("f")
    return one.select("m", cases).select("scenario", "cost_per_customer", F.round(v, 4).alias("value_per_customer"), F.round(v / F.col("cost_per_customer"), 4).alias("value_per_cost"))


@query("kmeans_segments")
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means on standardised RFM values."""
    return C.kmeans(rfm(spark, sf_dir), "customer", ["recency", "frequency", "monetary"], 4)


@query("cluster_sweep")
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia and silhouette of two to eight clusters."""
    return C.cluster_sweep(rfm(spark, sf_dir), "customer", ["recency", "frequency", "monetary"], starts=1)
