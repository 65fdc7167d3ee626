"""How the test tables become trials, series, ratings and so on; each as a frame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark, sf_dir) -> DataFrame:
    """One trial an event: task, agent, run (day), outcome Binary (value > 35) and Score."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("task_id"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("agent_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("ord"),
        (F.col("value") > 35).alias("passed"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), "value",
    )


TRIALS = """trials AS (SELECT event_type AS task_id, 'u' || CAST(user_id % 10 AS VARCHAR) AS agent_id, strftime(ts, '%Y-%m-%d') AS run_id,
 CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS ord, value > 35 AS passed, least(value / 500, 1.0) AS score, value FROM events)"""


def daily(spark, sf_dir) -> DataFrame:
    """series, ord (day number from 1), x (mean value of the day)."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"))
    return days.select("series", F.row_number().over(Window.partitionBy("series").orderBy("day")).cast("long").alias("ord"), "x")


DAILY = """daily AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY day) AS ord, x FROM
 (SELECT event_type AS series, CAST(ts AS DATE) AS day, avg(value) AS x FROM events GROUP BY 1, 2))"""


def observations(spark, sf_dir) -> DataFrame:
    """series, ord, x (0/1): whether an event's value is over 35."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), F.col("event_id").alias("ord"), (F.col("value") > 35).cast("double").alias("x"))


OBS = "obs AS (SELECT event_type AS series, event_id AS ord, CAST(value > 35 AS DOUBLE) AS x FROM events)"


def ratings(spark, sf_dir) -> DataFrame:
    """item, rater, label without gaps: users rated by event types."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("rater")).agg(F.avg("value").alias("v"))
    return r.select("item", "rater", F.least(F.lit(3), F.floor(F.col("v") / 15)).cast("int").alias("label"))


RATINGS = """ratings AS (SELECT user_id AS item, event_type AS rater, CAST(least(3, floor(avg(value) / 15)) AS INT) AS label FROM events GROUP BY 1, 2)"""


def gappy(spark, sf_dir) -> DataFrame:
    """item, rater, label with gaps: parts rated by groups of suppliers."""
    li = table(spark, sf_dir, "lineitem")
    r = li.groupBy(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 5).alias("rater")).agg(F.avg("l_quantity").alias("v"))
    return r.select("item", "rater", F.floor(F.col("v") / 10).cast("int").alias("label"))


GAPPY = """ratings AS (SELECT l_partkey AS item, l_suppkey % 5 AS rater, CAST(floor(avg(l_quantity) / 10) AS INT) AS label FROM lineitem GROUP BY 1, 2)"""


def paired(spark, sf_dir) -> DataFrame:
    """x, y: two measures of a part's price."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select((F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), F.col("p_retailprice").alias("y"))


PAIRED = "paired AS (SELECT l_extendedprice / l_quantity AS x, p_retailprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"


def win_rates(spark, sf_dir) -> DataFrame:
    """model_i, model_j, wr: share of days on which an event type has the higher mean; family by name."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy(F.col("event_type").alias("model"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    a, b = d.select(F.col("model").alias("model_i"), "day", F.col("v").alias("vi")), d.select(F.col("model").alias("model_j"), "day", F.col("v").alias("vj"))
    off = a.join(b, "day").where("model_i != model_j").groupBy("model_i", "model_j").agg(F.avg((F.col("vi") > F.col("vj")).cast("double")).alias("wr"))
    diag = d.select("model").distinct().select(F.col("model").alias("model_i"), F.col("model").alias("model_j"), (0.5 + 0.05 * (F.length("model") % 5)).alias("wr"))
    return off.unionByName(diag)


WINS = """d AS (SELECT event_type AS model, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
 wins AS (SELECT a.model AS model_i, b.model AS model_j, avg(CAST(a.v > b.v AS DOUBLE)) AS wr FROM d a JOIN d b ON a.day = b.day AND a.model <> b.model GROUP BY 1, 2
  UNION ALL SELECT DISTINCT model, model, 0.5::DOUBLE + 0.05::DOUBLE * (length(model) % 5) FROM d)"""


def labs(spark, sf_dir) -> DataFrame:
    """lab, x: 21 laboratories (return flag x line number) with one replicate a weekday, the day's mean quantity."""
    li = table(spark, sf_dir, "lineitem")
    r = li.groupBy(F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("lab"), F.weekday("l_shipdate").alias("k")).agg(F.avg("l_quantity").alias("x"))
    return r.select("lab", "x")


LABS = """labs AS (SELECT lab, x FROM (SELECT l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS lab, isodow(l_shipdate) AS k, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2))"""


def grid(spark, sf_dir) -> DataFrame:
    """p, i, r, x: event type x weekday x quarter of the day, cell means."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("p"), (F.weekday("ts")).cast("long").alias("i"), F.floor(F.hour("ts") / 6).cast("long").alias("r")).agg(F.avg("value").alias("x"))


GRID = """grid AS (SELECT event_type AS p, CAST(isodow(ts) - 1 AS BIGINT) AS i, CAST(floor(hour(ts) / 6) AS BIGINT) AS r, avg(value) AS x FROM events GROUP BY 1, 2, 3)"""


def responses(spark, sf_dir) -> DataFrame:
    """person, item, y (0/1): first answer of each person to each item."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    r = e.select(F.col("user_id").alias("person"), F.concat_ws("-", "event_type", F.floor(k / 20).cast("string")).alias("item"), F.struct("event_id", (F.col("value") > 35).cast("int").alias("y")).alias("s"))
    return r.groupBy("person", "item").agg(F.min("s").alias("s")).select("person", "item", F.col("s.y").alias("y"))


RESPONSES = """responses AS (SELECT user_id AS person, event_type || '-' || CAST(CAST(floor(CAST(json_extract(props, '$.k') AS INT) / 20) AS BIGINT) AS VARCHAR) AS item,
 arg_min(CAST(value > 35 AS INT), event_id) AS y FROM events GROUP BY 1, 2)"""


def pool(spark, sf_dir) -> DataFrame:
    """id, difficulty, discrimination, content_domain, exposure_count: parts as items."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), ((F.col("p_size") - 25) / 10.0).alias("difficulty"), (0.5 + (F.col("p_partkey") % 16) / 10.0).alias("discrimination"),
        F.col("p_type").alias("content_domain"), (F.col("p_partkey") % 7).alias("exposure_count"),
    )


POOL = """pool AS (SELECT p_partkey AS id, (p_size - 25) / 10.0::DOUBLE AS difficulty, 0.5::DOUBLE + (p_partkey % 16) / 10.0::DOUBLE AS discrimination, p_type AS content_domain, p_partkey % 7 AS exposure_count FROM part)"""


def changes(spark, sf_dir) -> DataFrame:
    """sha (month), seq, task_id (region), before, after: mean order price and the month's before it."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    m = j.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("sha"), F.col("r_name").alias("task_id")).agg(F.avg("o_totalprice").alias("after"))
    w = Window.partitionBy("task_id").orderBy("sha")
    return m.select("sha", "task_id", F.lag("after").over(w).alias("before"), "after").where("before IS NOT NULL")


CHANGES = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS sha, r_name AS task_id, avg(o_totalprice) AS after FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
 changes AS (SELECT * FROM (SELECT sha, task_id, lag(after) OVER (PARTITION BY task_id ORDER BY sha) AS before, after FROM m) WHERE before IS NOT NULL)"""
