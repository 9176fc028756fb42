"""Queries of the readers and writers, of column helpers that work by lookup or test, and of correlation with gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions.columns import ref
from riskloom.operators import association as T
from riskloom.operators import community as E
from riskloom.operators import figures as V
from riskloom.operators import models as L
from riskloom.plans.closed_forms import GROUPS_SQL, _one_factor
from riskloom.plans.registry import SITE_SQL, TAXA, query, rounded, site_table, table
from riskloom.sources import tables as IO


def _folder(spark: SparkSession, name: str) -> str:
    return f"{IO.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, trim(c_name) AS c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as delimited text with NA for missing balances and read back under the schema."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(ref("c_acctbal") >= 0, ref("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    return IO.write_table(cust, _folder(spark, "csv"), "csv")


@query("SELECT s_suppkey, s_name, n_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sheets_of_a_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets of one book, delimited text with NA and Parquet, joined."""
    book = _folder(spark, "book")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(ref("s_acctbal") > 0, ref("s_acctbal")).alias("s_acctbal"))
    IO.write_table(supplier, f"{book}/suppliers", "csv")
    IO.write_table(table(spark, sf_dir, "nation"), f"{book}/nations")
    rows = IO.read_sheet(spark, book, "suppliers", supplier.schema)
    names = IO.read_sheet(spark, book, "nations")
    return rows.join(names, rows["s_nationkey"] == names["n_nationkey"]).select("s_suppkey", "s_name", "n_name", "s_acctbal")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    IO.write_table(table(spark, sf_dir, "orders"), path := _folder(spark, "orders"))
    grouped = IO.read_table(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(grouped, "total", digits=2)


@query(f"""WITH {GROUPS_SQL} SELECT unit, round(e / n, 5) AS p_event FROM units JOIN g ON units.type = g.type""")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that was saved and loaded."""
    model, rows = _one_factor(spark, sf_dir)
    IO.save_model(model.pipeline, path := _folder(spark, "model"))
    again = L.Fitted(IO.load_model(path), model.names)
    return rounded(again.score(rows).select("unit", L.P), L.P, digits=5)


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem")
def select_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns whose names hold no key."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*[ref(c) for c in C.cols_where(lines, numeric=True, contains="l_", without="key")])


@query(f"WITH {SITE_SQL} SELECT user_id, {', '.join(f'round({t}, 6) AS taxon_{t}' for t in TAXA)}, grp FROM sites")
def rename_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new names are rows of a table."""
    lookup = table(spark, sf_dir, "events").select(ref("event_type").alias("old"), F.concat(F.lit("taxon_"), "event_type").alias("new"))
    return C.rename_from(rounded(site_table(spark, sf_dir), *TAXA), lookup, "old", "new")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_tax FROM lineitem")
def derive_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    out = C.derive_unused(lines, "net", ref("l_extendedprice") * (1 - ref("l_discount")), ["l_extendedprice", "l_discount"], after="l_linenumber")
    return rounded(out, "net", digits=4)


GAPS_SQL = """o AS (SELECT CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust,
  CAST(o_orderkey AS DOUBLE) AS key FROM orders)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.when(ref("o_totalprice") > 50000, ref("o_totalprice")).alias("price"), F.when(F.pmod("o_custkey", F.lit(7)) != 0, ref("o_custkey").cast("double")).alias("cust"),
        ref("o_orderkey").cast("double").alias("key"),
    )


def _pairs_sql(source: str) -> str:
    names = ["price", "cust", "key"]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        + (f"1.0 AS r FROM {source}" if a == b else f"round(corr({a}, {b}), 6) AS r FROM {source}") for a in names for b in names
    )


@query(f"WITH {GAPS_SQL} {_pairs_sql('o')}")
def corr_pairwise_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.corr_matrix(_gaps(spark, sf_dir), ["price", "cust", "key"], use="pairwise"), "r")


@query(f"WITH {GAPS_SQL}, w AS (SELECT * FROM o WHERE price IS NOT NULL AND cust IS NOT NULL) {_pairs_sql('w')}")
def corr_complete_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.corr_matrix(_gaps(spark, sf_dir), ["price", "cust", "key"], use="complete"), "r")


@query("""WITH t AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS b FROM events GROUP BY 1), c AS (SELECT count(*) AS n, corr(a, b) AS r FROM t),
s AS (SELECT r, abs(r) * sqrt(3 / (1 - r * r)) / sqrt(3) AS x FROM c WHERE n = 5)
SELECT round(r, 6) AS r, round(1 - 2 / pi() * (x / (1 + x * x) + atan(x)), 6) AS p FROM s""")
def corr_p_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p of a correlation over five groups: a t tail with three degrees of freedom, which has a closed form."""
    groups = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("b"))
    return rounded(T.corr_pvalues(groups, ["a", "b"]).where("var1 = 'a' AND var2 = 'b'").select("r", "p"), "r", "p")


@query(f"""WITH e AS (SELECT user_id, {', '.join(f"CASE WHEN event_type = '{t}' THEN value ELSE 0 END AS {t}" for t in TAXA)} FROM events)
SELECT user_id, {', '.join(f'round(ln(1 + avg({t})), 6) AS {t}' for t in TAXA)} FROM e GROUP BY 1""")
def site_means_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cover of a site over its samples, an event each."""
    samples = table(spark, sf_dir, "events").select("user_id", *[F.when(ref("event_type") == t, ref("value")).otherwise(0.0).alias(t) for t in TAXA])
    return rounded(E.site_means(samples, ["user_id"], TAXA), *TAXA)


@query("""WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS stat FROM customer GROUP BY 1)
SELECT c_mktsegment, round(stat, 6) AS stat, dense_rank() OVER (ORDER BY stat) AS ord FROM m""")
def level_order_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.level_order(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "mean"), "stat")
