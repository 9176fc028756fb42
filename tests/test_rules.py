import os

from pyspark.sql import functions as F

from riskloom.operators import rules as D

COLUMNS = "type string, time_since_af int, time_since_owm int, time_since_survey int, laid_up_more_10d int, ports_12m int, max_lu_12m int, av_speed double"


def label(spark, rule, column, **values):
    base = dict(type="Other", time_since_af=0, time_since_owm=0, time_since_survey=0, laid_up_more_10d=0, ports_12m=0, max_lu_12m=0, av_speed=20.0)
    base |= values
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return rule(spark.createDataFrame([tuple(base[n] for n in names)], COLUMNS)).first()[column]


def test_2017(spark):
    def run(**v):
        return label(spark, D.rules_2017, "pred_17", **v)

    assert run() == "pass"
    assert run(type="Bulk/Tanker", time_since_af=261) == "fail"
    assert run(type="Other", laid_up_more_10d=1, ports_12m=36) == "fail"  # open clause, any type
    assert run(type="Other", time_since_survey=201, time_since_af=501) == "fail"
    assert run(type="Container", time_since_owm=550) == "pass"
    assert run(type="Passenger", max_lu_12m=6) == "fail"
    assert run(type="Passenger", time_since_af=None, max_lu_12m=6) == "fail"
    assert run(type="RoRo", time_since_af=None, time_since_owm=None, ports_12m=None) == "pass"


def test_2021_written_and_bracketed(spark):
    def run(bracketed=False, **v):
        return label(spark, lambda d: D.rules_2021(d, bracketed=bracketed), "pred_21", **v)

    assert run(av_speed=11.0) == "fail"
    assert run(True, av_speed=11.0) == "pass"
    assert run(type="Bulk/Tanker", time_since_af=325) == "pass"  # the rule names another level
    assert run(type="Container", time_since_af=551) == "fail"
    assert run(True, type="RoRo", time_since_survey=330) == "fail"


def test_simple_keeps_unknown(spark):
    def run(v):
        return label(spark, D.rules_2021_simple, "pred_21_simple", time_since_af=v)

    assert (run(343), run(342), run(None)) == ("fail", "pass", None)


def test_rule_table_first_match(spark):
    rules = spark.createDataFrame([(2, "x > 0", "b"), (1, "x > 5", "a")], "ord int, predicate string, outcome string")
    df = spark.createDataFrame([(9,), (3,), (-1,), (None,)], "x int")
    assert [r["v"] for r in D.apply_rule_table(df, rules, "v", default="c").collect()] == ["a", "b", "c", "c"]


def test_rules_run_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("RoRo", 400), ("RoRo", 10)], "type string, time_since_af int")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    done = (
        D.rules_2021_simple(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out)
    )
    done.awaitTermination()
    assert os.path.isdir(out)
    got = {r["time_since_af"]: r["pred_21_simple"] for r in spark.read.parquet(out).select("time_since_af", F.col("pred_21_simple")).collect()}
    assert got == {400: "fail", 10: "pass"}
