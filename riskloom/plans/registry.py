"""Registry of queries on the driver tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import ship
from riskloom.functions.columns import ref
from riskloom.functions.text import recode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def keep(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(ref(c).cast("double"), digits) for c in names})


# Stand-in roles of the driver tables: a lineitem row is a sample, an order is a unit, a user of
# events is a site and an event type a taxon.
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TAXA = ["click", "error", "purchase", "signup", "view"]
SEGMENT_TYPE = {
    "AUTOMOBILE": "RoRo",
    "BUILDING": "Container",
    "FURNITURE": "Bulk",
    "HOUSEHOLD": "Passenger",
    "MACHINERY": "Tanker",
}


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as surveyed units, with the columns the rule sets use."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = orders.join(table(spark, sf_dir, "customer"), "c_custkey")
    key, cust = ref("o_orderkey"), ref("c_custkey")

    def wrapped(c: Column, size: int) -> Column:
        return F.pmod(c, F.lit(size)).cast("int")

    age = F.datediff(F.lit("2001-12-31").cast("date"), ref("o_orderdate").cast("date"))
    return joined.select(
        key.alias("unit"),
        recode(ref("c_mktsegment"), SEGMENT_TYPE).alias("type"),
        F.when(ref("o_orderstatus") == "F", F.lit("fail")).otherwise(F.lit("pass")).alias("crms"),
        wrapped(age, 700).alias("time_since_af"),
        wrapped(key, 600).alias("time_since_owm"),
        wrapped(cust, 400).alias("time_since_survey"),
        (ref("o_orderpriority") == "1-URGENT").cast("int").alias("laid_up_more_10d"),
        wrapped(cust, 11).alias("max_lu_12m"),
        wrapped(key, 97).alias("ports_12m"),
        (ref("o_totalprice") / 20000).alias("av_speed"),
        wrapped(key, 67).alias("NPorts"),
        wrapped(cust, 5).alias("MMDays"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("mpi_c"),
    )


UNITS_SQL = """units AS (
  SELECT o_orderkey AS unit,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RoRo' WHEN 'BUILDING' THEN 'Container' WHEN 'FURNITURE' THEN 'Bulk'
      WHEN 'HOUSEHOLD' THEN 'Passenger' WHEN 'MACHINERY' THEN 'Tanker' ELSE c_mktsegment END AS type,
    CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS crms,
    date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') % 700 AS time_since_af,
    o_orderkey % 600 AS time_since_owm, o_custkey % 400 AS time_since_survey,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS laid_up_more_10d,
    o_custkey % 11 AS max_lu_12m, o_orderkey % 97 AS ports_12m, o_totalprice / 20000 AS av_speed,
    o_orderkey % 67 AS NPorts, o_custkey % 5 AS MMDays, CAST(substr(o_orderpriority, 1, 1) AS INT) AS mpi_c
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x event types: log(1 + summed value) per taxon, 0 where a user has none."""
    return _cover(table(spark, sf_dir, "events").groupBy("user_id")).withColumn("grp", F.concat(F.lit("g"), F.pmod("user_id", F.lit(3))))


def day_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on days x event types, so that taxa are absent; ``user_id`` holds the site, user and day in one number."""
    sites = _cover(table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")))
    site = ref("user_id") * 100000 + F.datediff("day", F.lit("1970-01-01").cast("date"))
    return sites.select(site.alias("user_id"), *TAXA, F.concat(F.lit("g"), F.pmod("user_id", F.lit(3))).alias("grp"))


def _cover(grouped) -> DataFrame:
    return grouped.agg(*[F.log1p(F.coalesce(F.sum(F.when(ref("event_type") == t, ref("value"))), F.lit(0.0))).alias(t) for t in TAXA])


_COVER_SQL = ", ".join(f"ln(1 + coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0)) AS \"{t}\"" for t in TAXA)
SITE_SQL = f"sites AS (SELECT user_id, {_COVER_SQL}, 'g' || (user_id % 3) AS grp FROM events GROUP BY user_id)"
DAY_SQL = f"""sites AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS user_id, {_COVER_SQL}, 'g' || (e.user_id % 3) AS grp
  FROM events e GROUP BY e.user_id, CAST(ts AS DATE))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a length score in [0, 1)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.withColumn("score", ref("n_chars") / (ref("n_chars") + 1000))


SCORES_SQL = """scores AS (SELECT l.*, d.lang, d.source, d.n_chars, d.n_chars / (d.n_chars + 1000) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
