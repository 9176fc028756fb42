"""Queries: column work, joins, profiles and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import dates as D
from riskloom.functions import numeric as N
from riskloom.functions import text as X
from riskloom.functions.columns import ref
from riskloom.operators import community as E
from riskloom.operators import figures as V
from riskloom.operators import ordered as O
from riskloom.operators import prepare as P
from riskloom.operators import profile as A
from riskloom.operators.roc import to_series
from riskloom.plans.registry import DAY_SQL, MEASURES, SITE_SQL, TAXA, day_sites, query, rounded, site_table, table


@query("""SELECT l_linestatus AS line_status, l_orderkey AS order_key, l_quantity AS quantity, l_extendedprice AS extended_price,
  l_discount AS discount, l_tax AS tax_percent FROM lineitem""")
def range_select_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    picked = li.select(*C.cols_at(li, 0), *C.cols_between(li, "l_quantity", "l_tax"), "l_linestatus")
    titled = C.rename_from(
        picked,
        {"l_orderkey": "Order Key", "l_quantity": "Quantity", "l_extendedprice": "extendedPrice", "l_discount": "Discount", "l_tax": "Tax (%)", "l_linestatus": "LineStatus"},
    )
    return C.relocate(C.clean_names(titled), "line_status", before="order_key")


@query("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Promo' WHEN 'ECONOMY' THEN 'Economy' ELSE p_type END AS type_fixed,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZED' ELSE p_type END AS type_group,
  CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS big FROM part""")
def recode_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        X.recode(ref("p_type"), {"PROMO": "Promo", "ECONOMY": "Economy"}).alias("type_fixed"),
        X.collapse(ref("p_type"), "SIZED", ["SMALL", "MEDIUM", "LARGE"]).alias("type_group"),
        X.if_known(ref("p_size") > 25, "Yes", "No").alias("big"),
    )


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS stat FROM orders GROUP BY 1)
SELECT o_orderpriority, round(stat, 4) AS stat, dense_rank() OVER (ORDER BY stat) AS ord,
  CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 4 END AS stated,
  dense_rank() OVER (ORDER BY o_orderpriority DESC) AS reversed FROM m""")
def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    levels = V.level_order(orders, "o_orderpriority", "o_totalprice")
    codes = P.numbered(orders.select("o_orderpriority"), "o_orderpriority", "code")
    out = levels.join(codes, "o_orderpriority").withColumn("reversed", codes.agg(F.max("code")).scalar() + 1 - ref("code"))
    out = out.withColumn("stated", X.level_rank(ref("o_orderpriority"), ["5-LOW", "3-MEDIUM", "1-URGENT"]))
    return rounded(out, "stat", digits=4).select("o_orderpriority", "stat", "ord", "stated", "reversed")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days,
  greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0)::DOUBLE AS days_from_zero
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), ref("l_orderkey") == ref("o_orderkey"))
    days = D.days_between(ref("l_shipdate"), ref("o_orderdate"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", days.cast("long").alias("days"), N.at_least_zero(days).cast("double").alias("days_from_zero")
    )


@query(r"""SELECT doc_id, md5(trim(lower(text))) AS lowered, md5(replace(replace(text, '-', ''), ',', '')) AS bare,
  NOT regexp_matches(regexp_extract(text, '[^,]*$', 0), '[\p{L}\p{M}\p{N}_]') AS no_tail, upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS source_case,
  regexp_matches(text, '[0-9]{3}') AS has_number FROM documents""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(F.trim(F.lower("text"))).alias("lowered"),
        F.md5(X.strip_all(ref("text"), "-,")).alias("bare"),
        X.after_last_comma(ref("text")).isNull().alias("no_tail"),
        X.sentence_case(ref("source")).alias("source_case"),
        X.has_pattern(ref("text"), "[0-9]{3}").alias("has_number"),
    )


@query("""SELECT c_custkey, 'Customer ' || CAST(CAST(split_part(c_name, '#', 2) AS BIGINT) AS VARCHAR) AS title,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment_title, replace(c_name, '#', '') AS bare FROM customer""")
def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    number = F.get(F.split("c_name", "#"), F.lit(1)).cast("long")
    return cust.select(
        "c_custkey",
        F.concat(F.lit("Customer "), number).alias("title"),
        X.title_case(ref("c_mktsegment")).alias("segment_title"),
        X.strip_all(ref("c_name"), "#").alias("bare"),
    )


@query("""SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.x]', '', 'g') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def cast_dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        N.to_number(F.regexp_replace("props", "[^0-9.x]", "")).alias("k"),
        N.to_number(ref("event_type")).alias("not_a_number"),
    )


@query("""WITH f AS (SELECT c_nationkey AS k, max(c_acctbal) AS fix FROM customer GROUP BY 1),
c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, coalesce(bal, 0) AS filled, coalesce(CASE WHEN c_custkey = k THEN fix END, bal) AS patched
FROM c LEFT JOIN f ON c_custkey = k""")
def patch_and_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    bal = cust.select("c_custkey", F.when(ref("c_acctbal") >= 0, ref("c_acctbal")).alias("patched"))
    fixes = cust.groupBy(ref("c_nationkey").cast("long").alias("c_custkey")).agg(F.max("c_acctbal").alias("fix"))
    both = bal.withColumn("filled", ref("patched"))
    return P.patch(P.fill(both, ["filled"], 0.0), "c_custkey", "patched", fixes, "fix")


@query("""SELECT c_custkey, n_name, c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def left_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = table(spark, sf_dir, "nation").select(ref("n_nationkey").alias("c_nationkey"), "n_name")
    return P.lookup_join(table(spark, sf_dir, "customer"), lookup, "c_nationkey").select("c_custkey", "n_name", "c_mktsegment")


@query("""SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return P.lookup_join(nation, region, {"n_regionkey": "r_regionkey"}).select("n_nationkey", "n_name", "r_name")


@query("""SELECT n_nationkey, n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IS NOT NULL""")
def right_join_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a supplier, as small tables have them, drop out."""
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    out = P.align(suppliers, table(spark, sf_dir, "nation"), ["n_nationkey"], ["s_suppkey"])
    return out.select("n_nationkey", "n_name", "s_suppkey")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE CAST(c_nationkey AS VARCHAR) END AS label FROM customer)
SELECT c_custkey, coalesce(n_name, label) AS label FROM c LEFT JOIN nation ON label = CAST(n_nationkey AS VARCHAR)""")
def relabel_from_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is a level; a label that is none stays."""
    lookup = table(spark, sf_dir, "nation").select(ref("n_nationkey").cast("string").alias("k"), "n_name")
    label = F.when(ref("c_acctbal") < 0, F.lit("in debt")).otherwise(ref("c_nationkey").cast("string"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return P.recode_from(cust, "label", lookup, "k", "n_name").select("c_custkey", "label")


GAPPY = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END"


@query(f"""WITH t AS (SELECT {GAPPY} AS value, count(*) AS n FROM customer GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER (), 6) AS percent,
  round(CASE WHEN value IS NOT NULL THEN n END / sum(CASE WHEN value IS NOT NULL THEN n END) OVER (), 6) AS valid_percent FROM t""")
def freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").withColumn("segment", F.when(ref("c_acctbal") >= 0, ref("c_mktsegment")))
    return rounded(A.freq_table(cust, "segment"), "percent", "valid_percent")


@query("""WITH a AS (SELECT DISTINCT o_orderpriority FROM orders), b AS (SELECT DISTINCT o_orderstatus FROM orders),
t AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.o_orderpriority, b.o_orderstatus, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN t
  ON t.o_orderpriority = a.o_orderpriority AND t.o_orderstatus = b.o_orderstatus""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
  count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus IS NULL) AS NA_ FROM orders GROUP BY 1""")
def crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crosstab_wide(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH t AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT *, round_even(n / sum(n) OVER (PARTITION BY o_orderpriority), 2) AS prop FROM t""")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_share(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"])


@query("""SELECT o_orderstatus, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 2) AS prop FROM orders GROUP BY 1""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_share(table(spark, sf_dir, "orders"), ["o_orderstatus"])


LONG_SQL = """WITH long AS (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(table(spark, sf_dir, "lineitem"), MEASURES, ["l_returnflag", "l_linestatus"])


@query(f"""{LONG_SQL} SELECT name, l_returnflag, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max
  FROM long GROUP BY 1, 2""")
def group_min_med_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.group_min_med_max(_long(spark, sf_dir), ["name", "l_returnflag"], "value"), "median")


@query(f"""{LONG_SQL} SELECT name, l_returnflag, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median,
  min(value) AS min, max(value) AS max, round(stddev_samp(value), 4) AS sd, count(*) AS n,
  round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3,
  round(stddev_samp(value) / sqrt(count(*)), 4) AS se FROM long GROUP BY 1, 2""")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.group_moments(_long(spark, sf_dir), ["name", "l_returnflag"], "value")
    return rounded(out, "mean", "median", "sd", "q1", "q3", "se", digits=4)


@query(f"""{LONG_SQL} SELECT name, l_linestatus, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd,
  round(stddev_samp(value) / sqrt(count(*)), 4) AS se, round(1.96 * stddev_samp(value) / sqrt(count(*)), 4) AS ci FROM long GROUP BY 1, 2""")
def group_se_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.group_se_ci(_long(spark, sf_dir), ["name", "l_linestatus"], "value"), "mean", "sd", "se", "ci", digits=4)


FLAGGED = ["f_qty", "f_disc", "f_tax"]
FLAG_SQL = """f AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END
  + CASE WHEN l_tax > 0.075 AND l_quantity > 40 THEN 1 ELSE 0 END AS s FROM lineitem)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        (ref("l_quantity") > 49).cast("int").alias("f_qty"),
        (ref("l_discount") > 0.095).cast("int").alias("f_disc"),
        ((ref("l_tax") > 0.075) & (ref("l_quantity") > 40)).cast("int").alias("f_tax"),
    )


@query(f"""WITH {FLAG_SQL}, g AS (SELECT l_suppkey, l_returnflag, avg(s) AS m FROM f GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, round(m, 6) AS mean_area, CASE WHEN m > 0 THEN 1 ELSE 0 END AS failed,
  CASE WHEN m > 0 THEN 'Fail' ELSE 'Pass' END AS status,
  CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS BIGINT) AS sum_fail,
  round(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) / count(*) OVER (PARTITION BY l_suppkey), 6) AS fail_prop FROM g""")
def unit_means_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.unit_status(_flags(spark, sf_dir), ["l_suppkey"], ["l_returnflag"], FLAGGED)
    return rounded(out, "mean_area", "fail_prop")


@query(f"""WITH {FLAG_SQL}, g AS (SELECT l_suppkey, l_returnflag, sum(s) AS t, count(*) AS n FROM f GROUP BY 1, 2)
SELECT l_returnflag, round(avg(CASE WHEN t > 0 THEN 1 ELSE 0 END / n), 8) AS m FROM g GROUP BY 1""")
def area_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = A.unit_status_sum(_flags(spark, sf_dir), ["l_suppkey"], ["l_returnflag"], FLAGGED)
    return rounded(A.area_ranking(status, ["l_returnflag"]), "m", digits=8)


@query("""SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS l_quantity,
  round(CASE WHEN count(*) = count(CASE WHEN l_discount > 0 THEN 1 END) THEN avg(l_discount) END, 6) AS l_discount FROM lineitem GROUP BY 1, 2""")
def strict_unit_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(ref("l_discount") > 0, ref("l_discount")))
    return rounded(A.unit_means(li, ["l_suppkey", "l_returnflag"], ["l_quantity", "l_discount"]), "l_quantity", "l_discount")


@query("""SELECT var, nas FROM (SELECT 'c_acctbal' AS var, count(*) FILTER (c_acctbal < 0) AS nas FROM customer
  UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer UNION ALL SELECT 'c_name', 0)""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select(
        F.when(ref("c_acctbal") >= 0, ref("c_acctbal")).alias("c_acctbal"),
        F.when(ref("c_mktsegment") != "BUILDING", ref("c_mktsegment")).alias("c_mktsegment"),
        "c_name",
    )
    return A.null_profile(cust)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sample id made from the whole text; equal texts share it."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sample_id"))


@query("""SELECT doc_id, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM documents) WHERE c > 1""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_rows(_sampled(spark, sf_dir), ["sample_id"]).drop("sample_id")


@query("""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keep_first(_sampled(spark, sf_dir), ["sample_id"], [ref("doc_id")]).drop("sample_id")


@query("""SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""WITH c AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer),
long AS (SELECT 'c_acctbal' AS var, c_acctbal AS value FROM c UNION ALL SELECT 'c_nationkey', c_nationkey FROM c)
SELECT var, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(avg(value), 4) AS mean,
  round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS max, count(*) - count(value) AS nas FROM long GROUP BY 1""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(ref("c_acctbal") >= 0, ref("c_acctbal")))
    return rounded(A.summary_stats(cust, ["c_acctbal", "c_nationkey"]), "q1", "median", "mean", "q3", digits=4)


@query("""SELECT CAST(min(o_orderdate) AS VARCHAR) AS min, CAST(max(o_orderdate) AS VARCHAR) AS max FROM orders""")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.column_range(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.select(F.date_format("min", "yyyy-MM-dd HH:mm:ss").alias("min"), F.date_format("max", "yyyy-MM-dd HH:mm:ss").alias("max"))


@query("""SELECT 'supplier' AS dataset, s_nationkey AS nationkey, s_acctbal AS acctbal, NULL AS c_mktsegment FROM supplier
UNION ALL SELECT 'customer', c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def stack_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup, cust = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    sup = sup.select(ref("s_nationkey").alias("nationkey"), ref("s_acctbal").alias("acctbal"))
    cust = cust.select(ref("c_nationkey").alias("nationkey"), ref("c_acctbal").alias("acctbal"), *C.others(cust, "c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    return P.stack({"supplier": sup, "customer": cust})


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(ref("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer) WHERE c_mktsegment IS NOT NULL""")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.when(ref("c_acctbal") >= 0, ref("c_mktsegment")).alias("c_mktsegment"))
    return cust.na.drop(subset=C.columns_with_nulls(cust))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)""")
def excluded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "nation").select(ref("n_nationkey").cast("long").alias("c_custkey"))
    return P.exclude_keys(table(spark, sf_dir, "customer"), "c_custkey", keys).select("c_custkey", "c_acctbal")


@query("""SELECT sample, round(CASE WHEN c0 IS NULL AND cover = 0 AND lof = 0 THEN 100 WHEN c0 IS NULL AND cover = 0 THEN 100 - film ELSE c0 END, 6) AS clean FROM
  (SELECT l_orderkey * 10 + l_linenumber AS sample, l_partkey AS film_key, CASE WHEN l_discount > 0.08 THEN NULL WHEN l_discount < 0.01 THEN 0 ELSE l_extendedprice END AS c0,
   l_tax AS cover, CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END AS lof, l_quantity AS film FROM lineitem)""")
def backfill_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    clean = F.when(ref("l_discount") > 0.08, F.lit(None)).when(ref("l_discount") < 0.01, F.lit(-1.0)).otherwise(ref("l_extendedprice"))
    rating = F.when(ref("l_quantity") > 25, 0).otherwise(1)
    repaired, _ = P.backfill_clean(clean, ref("l_quantity"), ref("l_tax"), rating)
    out = li.select((ref("l_orderkey") * 10 + ref("l_linenumber")).alias("sample"), repaired.alias("clean"))
    return rounded(out, "clean")


@query("""WITH w AS (SELECT p_partkey, p_retailprice AS "price.list", p_size::DOUBLE AS "size.raw" FROM part)
SELECT p_partkey, 'price' AS what, 'list' AS kind, "price.list" AS value FROM w UNION ALL SELECT p_partkey, 'size', 'raw', "size.raw" FROM w""")
def unpivot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", ref("p_retailprice").alias("price~list"), ref("p_size").alias("size~raw"))
    return A.split_name(to_series(part, ["price~list", "size~raw"], ["p_partkey"]), "name", ["what", "kind"])


@query(f"""WITH {DAY_SQL} SELECT user_id, round({' + '.join(TAXA)}, 6) AS total, CAST({' + '.join(f'(CASE WHEN {t} > 0 THEN 1 ELSE 0 END)' for t in TAXA)} AS INT) AS richness,
  {', '.join(f'CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END AS {t}' for t in TAXA)} FROM sites""")
def row_sum_richness_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = day_sites(spark, sf_dir)
    taxa = [ref(t) for t in TAXA]
    counted = sites.withColumn("total", F.round(N.row_sum(taxa), 6)).withColumn("richness", N.richness(taxa))
    return E.presence_table(counted, TAXA).select("user_id", "total", "richness", *TAXA)


@query("""SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS code FROM orders""")
def dense_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked_codes(table(spark, sf_dir, "orders"), [], "o_custkey", "code").select("o_orderkey", "code")


@query("""SELECT n_name, row_number() OVER (ORDER BY n_name) AS no FROM nation""")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered(table(spark, sf_dir, "nation").select("n_name"), "n_name", "no")


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice = 0 THEN 0 ELSE round_even(p_retailprice / 10 ** (floor(log10(abs(p_retailprice))) - 1), 0)
  * 10 ** (floor(log10(abs(p_retailprice))) - 1) END, 6) AS price2, round_even(p_retailprice, 0) AS price0 FROM part""")
def signif_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    out = part.select("p_partkey", N.signif(ref("p_retailprice"), 2).alias("price2"), N.half_even(ref("p_retailprice")).alias("price0"))
    return rounded(out, "price2")


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 1""")
def top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").select("c_nationkey", "c_custkey", "c_acctbal")


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return A.first_rows(cust, [F.desc_nulls_last("c_acctbal"), F.asc_nulls_last("c_custkey")])


@query(f"""{LONG_SQL}, e AS (SELECT name, min(value) AS low, max(value) AS high FROM long GROUP BY 1)
SELECT long.name, l_returnflag, CAST(greatest(ceil((value - low) / ((high - low) / 9.0::DOUBLE) - 0.5), 0) AS INT) AS bin, count(*) AS n
FROM long JOIN e ON long.name = e.name GROUP BY 1, 2, 3""")
def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hist_bins(_long(spark, sf_dir), "value", 10, ["name"], ["l_returnflag"]).drop("centre")


@query("""WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT p AS o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS whisker_low,
  max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS whisker_high,
  count(*) AS n, count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM orders JOIN q ON o_orderpriority = p GROUP BY p, q1, median, q3""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.box_stats(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]), "q1", "median", "q3", digits=4)


@query("""WITH q AS (SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN q ON event_type = t WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.outlier_rows(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "event_type", "value")


@query("""WITH t AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS prop FROM t""")
def stacked_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.stacked_share(table(spark, sf_dir, "orders"), [], "o_orderstatus", "o_orderpriority"), "prop")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def count_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.count_bars(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(f"""WITH {FLAG_SQL}, g AS (SELECT l_suppkey, l_returnflag, avg(s) AS m FROM f GROUP BY 1, 2),
h AS (SELECT *, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) / count(*) OVER (PARTITION BY l_suppkey) AS fp FROM g),
a AS (SELECT l_returnflag AS k, dense_rank() OVER (ORDER BY quantile_cont(m, 0.5)) AS area_ord FROM h GROUP BY 1),
u AS (SELECT l_suppkey AS k, dense_rank() OVER (ORDER BY quantile_cont(fp, 0.5)) AS unit_ord FROM h GROUP BY 1)
SELECT l_suppkey, l_returnflag, round(m, 6) AS mean_area, area_ord, unit_ord FROM h JOIN a ON l_returnflag = a.k JOIN u ON l_suppkey = u.k""")
def heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = A.unit_status(_flags(spark, sf_dir), ["l_suppkey"], ["l_returnflag"], FLAGGED)
    grid = V.heat_grid(status, "l_suppkey", "l_returnflag", "mean_area", "fail_prop")
    return rounded(grid, "mean_area").select("l_suppkey", "l_returnflag", "mean_area", "area_ord", "unit_ord")


@query("""SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders""")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scatter(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", "o_orderkey", ["o_orderstatus"])


@query(f"""WITH {SITE_SQL}, m AS (SELECT grp, {', '.join(f'avg({t}) AS {t}' for t in TAXA)} FROM sites GROUP BY 1), l AS (UNPIVOT m ON {', '.join(TAXA)} INTO NAME name VALUE value)
SELECT grp, name, round(value, 6) AS value, round(value / sum(value) OVER (PARTITION BY grp), 6) AS share FROM l""")
def taxa_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.taxa_share(site_table(spark, sf_dir), ["grp"], TAXA), "value", "share")
