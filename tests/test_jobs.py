"""End-to-end jobs on small made-up tables in the shapes the jobs expect."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans import fouling, indicators, modelling, survey

DAY = dt.date(2021, 6, 1)


def ago(days):
    return DAY - dt.timedelta(days=int(days))


@pytest.fixture(scope="module")
def raw_form(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        af = int(rng.integers(20, 900))
        rows.append((
            "x", "x", "x", "x", "x", i, ["Auckland", "Tauranga"][i % 2], DAY, f"Ship {i}", "No", ["Reefer", "RoRo", "Bulk"][i % 3],
            "port VILA", "1 day", *[float(v) for v in rng.normal(20, 5, 6)], float(rng.integers(1, 60)), float(i % 2), float(rng.integers(0, 9)),
            ago(rng.integers(1, 400)), ago(rng.integers(1, 900)), ago(af), int(1 + i % 3), "  ALL hull ", "Biocidal", "Yes", None, "Every 2 months",
            ["Yes, twice", "No"][i % 2], ["No", None][i % 2], None if i % 2 else ago(10), "No", None, [">50", "0", "1 - 5"][i % 3], "0",
            "Nuku, Tonga", ago(30) if i % 2 else None, ago(20) if i % 2 else None, ago(9), ago(7), "yes SET", "Yes", "Pass", ago(100),
        ))
    names = [
        "s1", "s2", "s3", "s4", "s5", "Vessel number", "1 Port of arrival in New Zealand", "2 Date of arrival", "5 Vessel registered name",
        "14 Is this vessel chartered?", "type raw", "Port_of_registration", "Time_in_NZ", "Tonnage_DWT", "Max_draught", "LOA", "Beam", "Av_speed", "Max_speed",
        "Ports_12m", "Laid_up_more_10d", "Max_LU_12m", "Last_class_survey", "Last out-of-water maintenance date", "27 Coating applied?", "28 How many coatings?",
        "AF_applied", "Hull protection", "MGSP", "Intake_treatment", "Regular_intake_treatment", "Cleaning_since_AF", "Hull_works_since_AF", "43 Works date",
        "44 Deficiencies?", "45 Which?", "47 Ports", "48 Countries", "52 Anchorage", "53 Idle start", "54 Idle end", "56 Last port arrival", "57 Last port departure",
        "Set_route", "Inspection", "62 Outcome", "63 Last inspection",
    ]
    kinds = ["string"] * 5 + ["int", "string", "date", "string", "string", "string", "string", "string"] + ["double"] * 9 + ["date"] * 3 + ["int"] + ["string"] * 7
    kinds += ["date"] + ["string"] * 5 + ["date"] * 4 + ["string"] * 3 + ["date"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame([(i, f"Ship {i}", ["FAIL", "pass"][(i // 2) % 2]) for i in range(58)], "`Vessel` int, Name string, `Pass/Fail` string")


@pytest.fixture(scope="module")
def clean(spark, raw_form, outcomes, tmp_path_factory):
    form = spark.createDataFrame([("type raw", "q11"), ("unknown question", "q99")], "`2021` string, qid string")
    mapping = spark.createDataFrame([("q11", "Type"), ("q0", "Nobody")], "qid string, question_17 string")
    alignment = survey.align_questions(form, mapping, ["qid"])
    assert [tuple(r) for r in alignment.select("name_2021", "question_17").collect()] == [("type raw", "Type")]
    return survey.prepare_questionnaire(raw_form, alignment, outcomes, str(tmp_path_factory.mktemp("q") / "clean")).persist()


def test_prepare_questionnaire(clean):
    rows = {r["Vessel number"]: r for r in clean.collect()}
    r0, r1 = rows[0], rows[1]
    assert r0["Type"] == "Container" and r0["crms"] == "Fail" and rows[59]["crms"] is None
    assert (r0["Multi_AF"], r1["Multi_AF"]) == ("No", "Yes")
    assert (r0["Cleaning_since_AF"], r1["Cleaning_since_AF"]) == ("Yes", "No")
    assert (r0["Hull_works_since_AF"], r1["Hull_works_since_AF"]) == ("No", None)
    assert r0["time_since_cleaning"] == 10 and r1["time_since_cleaning"] == r1["Time_since_AF"]
    assert r1["no_idle_days"] == 10 and r1["time_since_idle"] == 20 and r0["no_idle_days"] is None
    assert r0["time_since_last_port"] == 7 and r0["time_in_last_port"] == 2 and r0["time_since_last_inspection"] == 100
    assert r0["Regular_intake_treatment"] == "Every 1 - 3 months" and r0["AF_applied"] == "All hull"
    assert r0["Port_of_registration"] == "Port vila" and r0["Set_route"] == "Yes set"
    assert [rows[i]["ports_since_owm_ord"] for i in range(3)] == [6, 1, 2]


def test_profile_questionnaire(clean):
    tables = survey.profile_questionnaire(clean)
    assert len(tables) > 60
    looked_at = [n for n in tables if not n.startswith(("bars ", "table ", "share ", "fisher ")) or n.endswith(("ports_since_owm", "Multi_AF"))]
    for name in looked_at:
        assert tables[name].count() > 0, name
    assert abs(sum(r["prop"] for r in tables["crms"].collect()) - 1) < 0.02
    assert tables["anchorage_country"].first()["country"] == "Tonga"


@pytest.fixture(scope="module")
def model_data(spark, clean):
    older = clean.select(
        (F.col("Vessel number") + 100).alias("Nr"), F.lower("crms").alias("LOF_fail_mpi"),
        F.when(F.col("Vessel number") == 7, F.lit("Fishing")).when(F.col("Vessel number") % 5 == 0, F.lit("Passenger")).otherwise(F.col("Type")).alias("Type"),
        *[c for c in clean.columns if c.startswith(("Tonnage", "Max_", "LOA", "Beam", "Av_", "Ports_12m", "Laid", "Time_since"))],
        F.lit(None).cast("string").alias("Cleaning_since_AF"), F.lit("Yes").alias("Hull_works_since_AF"),
    )
    older = older.withColumn("Beam", F.when(F.col("Nr") % 9 != 0, F.col("Beam")))
    table, gaps = survey.stack_surveys(clean, older)
    assert {r["var"]: r["nas"] for r in gaps.collect()} == {"crms": 4, "beam": 6, "hull_works_since_af": 30}
    return table.where("crms IS NOT NULL").persist()


def test_stack_surveys(model_data):
    assert model_data.columns == [
        "vessel_number", "dataset", "crms", "type", "tonnage_dwt", "max_draught", "loa", "beam", "av_speed", "max_speed", "ports_12m",
        "laid_up_more_10d", "max_lu_12m", "time_since_survey", "time_since_af", "time_since_owm", "cleaning_since_af", "hull_works_since_af",
    ]
    assert model_data.where("type = 'Fishing'").count() == 0
    assert model_data.where("beam IS NULL").count() == 0
    older = model_data.where("dataset = 'quest_17'").agg(F.max("cleaning_since_af"), F.min("hull_works_since_af")).first()
    assert tuple(older) == (0, 1)


def test_screen_predictors(spark, model_data):
    labels = spark.createDataFrame([("time_since_af", "Time since AF")], "name string, Predictor string")
    out = indicators.screen_predictors(model_data, labels)
    assert {r["name"] for r in out["summary"].collect()} == set(model_data.columns[4:16])
    by_type = out["summary_by_type"].toPandas()
    assert not by_type.duplicated(["name", "type"]).any()
    assert all(r["auc"] > 0.7 for r in out["strong_by_type"].collect())
    assert out["report"].count() >= 12 and out["curves"].count() > 100 and out["curves_by_type"].count() > 100


@pytest.fixture(scope="module")
def all_data(spark, model_data):
    voyages = [(["KML", "NZD", "ZZZ"][i % 3], f"A-{i}", float(50 + 13 * i % 800), float(i % 60), float(i % 7), float(i % 4)) for i in range(60)]
    voyages = spark.createDataFrame(voyages, "Provider string, QuesCode string, AFInt double, NPorts double, MMDays double, PortDays double")
    known = spark.createDataFrame([(f"A{i}", ["Reefer", "Bulk"][i % 2], ["fail", "pass"][i % 4 == 0]) for i in range(50)], "vessel_code string, vessel_type string, crms string")
    return indicators.merge_sources(voyages, known, model_data).persist()


def test_merge_sources(all_data, model_data):
    assert all_data.where("vessel_code IS NOT NULL").count() == len([i for i in range(50) if i % 3 != 2])
    assert {r["type"] for r in all_data.select("type").distinct().collect()} <= {"Cargo", "Bulk/Tanker", "RoRo", "Passenger"}
    out = indicators.screen_merged(all_data, points=11)
    assert out["rows"].first()["n"] == all_data.count()
    assert {r["name"] for r in out["summary"].collect()} <= {"time_since_af", "NPorts", "MMDays", "PortDays"}
    for name in ("counts", "bins", "report", "curves", "summary_by_type", "curves_by_type", "selection"):
        assert out[name].count() > 0, name


def test_validate_rule_sets(model_data, all_data):
    out = indicators.validate_rule_sets(model_data, all_data)
    n = sum(r["n"] for r in out["rules_2017 matrix"].collect())
    assert n == model_data.where("dataset = 'quest_21'").count()
    assert sum(r["n"] for r in out["merged matrix"].collect()) == all_data.count()
    assert {r["term"] for r in out["merged_simple"].collect()} >= {"accuracy", "kap"}
    assert out["misclassified"].count() >= 0


def test_validate_score(spark):
    rows = [(f"v{i}", "RoRo", i % 4, "c", ["FAIL", "Pass"][i % 3 == 0], 2, "bow", 10.0 * i, 1.0, "tail") for i in range(24)]
    tracking = spark.createDataFrame(rows, "Name string, Type string, `MPI c` int, `Caw c` string, `Pass/Fail` string, Other int, `Areas failing` string, a double, b double, z string")
    out = indicators.validate_score(tracking)
    assert {(r["truth"], r["estimate"]) for r in out["matrix"].collect()} == {(a, b) for a in ("fail", "pass") for b in ("fail", "pass")}
    metrics = {r["metric"]: r["estimate"] for r in out["metrics"].collect()}
    wrong = out["misclassified"].count()
    assert abs(metrics["accuracy"] - (24 - wrong) / 24) < 1e-12
    assert out["roc"].count() == 4 + 2 and 0 <= out["auc"].first()["auc"] <= 1


@pytest.fixture(scope="module")
def raw_samples(spark):
    rng = np.random.default_rng(12)
    taxa = ["Gooseneck", "Fil green algae", "Macro algae", "Ascidians"]
    flags = ["Green algae >50mm length", "Barnacle 10", "Other organism 45"]
    names = ["Sample ID", "Vessel", "Type", "Category", "Hull depth", "Area_8", "Area_32", "Side (Port/Stbd)", "Region (St/Mid/Bow)", "Area sampled",
             "Mobiles (write in)", "LoF", "Macro percent cover", "Highest FR rating", "Caw risk score", "Clean hull", "Biofilm", *taxa, "Other", *flags]
    rows = []
    for i in range(96):
        vessel = ["MAERSK GARRONE", "xing zhi-hai", "blue star", "south sea"][i % 4] + ("" if i < 80 else f" {i % 8}")
        rows.append((
            f"s{i % 90}", vessel, ["reefer", "bulk"][i % 2], "Niche", ["FB", "Mid"][i % 2], ["Rudder T", "Dock block", "Hull", "ISea chest", "Anode"][i % 5], "z", ["P", None][i % 2],
            ["Mid", "Bow"][i % 2], ["TRUE", "FALSE"][i % 19 == 18], ["Crab", "Whelks?", None][i % 3], 0.0 if i % 7 == 0 else float(i % 4), 0.0 if i % 7 == 0 else 5.0, 1.0, float(i % 3),
            None if i % 7 == 0 else -1.0 if i % 11 == 0 else 50.0, None if i % 13 == 0 else 5.0,
            *[None if i % 17 == 0 else float(rng.random() < 0.5) * float(rng.integers(1, 9)) for _ in taxa], 0.0, *[float(rng.random() < 0.2) for _ in flags],
        ))
    kinds = ["string"] * 11 + ["double"] * (len(names) - 11)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


@pytest.fixture(scope="module")
def samples(spark, raw_samples):
    tracking = spark.createDataFrame([("maersk garrone", "Fail"), ("XING ZHI-HAI", "Pass"), ("Blue Star", "Pass"), ("SOUTH SEA", "Fail"), *[(f"{n} {k}", o) for n, o in (("Maersk Garrone", "Fail"), ("Xing Zhi-Hai", "Pass"), ("Blue Star", "Pass"), ("South Sea", "Fail")) for k in range(8)]], "Name string, `Pass/Fail` string")
    table = fouling.vessel_outcomes(tracking)
    assert {r["vessel"] for r in table.collect()} >= {"Maersk Garonne", "Xing Zhi-Hai", "Blue Star", "South Sea"}
    fixed = raw_samples.withColumn("Vessel", F.when(F.col("Vessel") == "MAERSK GARRONE", "MAERSK GARONNE").otherwise(F.col("Vessel")))
    return fouling.prepare_samples(fixed, table).persist()


def test_prepare_samples(samples):
    names = samples.columns
    assert names[names.index("ascidians") + 1 :][:2] == ["crab", "gastropod"]
    assert names[names.index("area") + 1 :][:2] == ["area_type", "subarea"]
    assert names[names.index("caw_risk_score") + 1] == "crms" and names[names.index("FR rating") + 1] == "Richness"
    assert samples.where("subarea = 'ISea chest' OR area_sampled <> 'TRUE'").count() == 0
    assert {r["area"] for r in samples.select("area").distinct().collect()} == {"Rudder and shaft", "DDSS", "Hull", "Anode"}
    assert {r["type"] for r in samples.select("type").distinct().collect()} == {"Container", "Bulk"}
    assert samples.where("gooseneck IS NULL OR crms IS NULL OR Richness IS NULL").count() == 0
    assert samples.where("clean_hull < 0").count() == 0
    assert {r["region"] for r in samples.select("region").distinct().collect()} == {"Midships", "Bow"}
    row = samples.orderBy("sample_id").first()
    taxa = [row[c] for c in names[names.index("gooseneck") : names.index("other") + 1]]
    assert row["Richness"] == sum(v > 0 for v in taxa)


def test_quality_report(samples):
    out = fouling.quality_report(samples, ["area", "side"], "sample_id", ["LoF", "Richness"])
    repeated = samples.groupBy("sample_id").count().where("count > 1").count()
    assert out["duplicates"].count() == repeated > 0
    assert out["summary"].count() == 2 and out["levels area"].count() == 4


def test_community_report(samples):
    # Covers with gaps left over make strict means null; those sites drop out.
    whole = samples.na.fill(0.0, subset=["clean_hull", "biofilm"])
    out = fouling.community_report(whole, permutations=19)
    for name, table in out.items():
        assert table.count() > 0, name
    shares = out["taxa_share"].groupBy("crms", "type").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares)


def test_status_report(spark, samples):
    criteria = spark.createDataFrame([("barnacle_10", "Barnacles", "hull")], "value string, name_long string, area string")
    out = fouling.status_report(samples, criteria)
    status = out["status"].toPandas()
    for _, part in status.groupby("vessel_code"):
        assert (part["sum_fail"] == part["failed"].sum()).all()
    vessels = status["vessel_code"].nunique()
    assert set(status["vessel_no"]) == set(range(1, vessels + 1))
    assert out["criteria"].where("name_long = 'Barnacles'").count() == samples.select("vessel_code", "type").distinct().count()
    ranked = [r["m"] for r in out["area_ranking"].collect()]
    assert ranked == sorted(ranked, reverse=True)
    assert out["grid_area"].count() == out["status"].count()


def test_prepare_internals(spark):
    taxa = ["gooseneck", "fil green algae", "macroalgae", "barnacles", "tubeworms", "bryozoans", "bivalves", "hydroids", "anemones", "ascidians", "othersp", "mobiles"]
    names = ["vessel id", "rrisk", "inside grate", "area", *[f"f{i}" for i in range(10)], "macro cover", *taxa, "pass fail i"]
    row = ["7", "3", "TRUE", "seachest", *["x"] * 10, " 12.5", *[str(i) for i in range(12)], "1"]
    other = ["8", "3", "FALSE", "seachest", *["x"] * 10, "n/a", *["?"] * 12, "0"]
    df = spark.createDataFrame([tuple(row), tuple(other), (*row[:3], "grate", *row[4:])], names)
    out = fouling.prepare_internals(df).collect()
    assert len(out) == 1 and out[0]["macro_cover"] == 12.5 and out[0]["taxa_diversity"] == sum(range(11))
    text = fouling.internals_as_text(fouling.prepare_internals(df)).first()
    assert text["taxa_diversity"] == sum(range(12)) and text["vessel_id"] == "7.0"


def test_compare_candidates(spark, model_data, tmp_path):
    names = spark.createDataFrame([("time_since_af", "Time since AF"), ("loa", "Length")], "name string, new_name string")
    out = modelling.compare_candidates(
        model_data, names, path=str(tmp_path / "r"), folds=2, repeats=1,
        forest_grid=[{"trees": 5, "mtry": 2, "depth": 3}], boosted_grid=[{"trees": 3, "depth": 1}], extreme_grid=[{"trees": 3, "depth": 2, "shrinkage": 0.3}],
    )
    table = out["comparison"].toPandas()
    assert set(table["model"]) == {"RF", "GLM", "BRT", "Xboost"} and set(table["metric"]) == {"ROC", "Sens", "Spec"}
    assert {r["var1"] for r in out["correlation"].collect()} >= {"Time since AF", "Length"}
    assert {r["new_name"] for r in out["predictors"].collect()} == {"Time since AF"}
    for name in ("classes", "classes_by_type", "correlation_p", "resamples"):
        assert out[name].count() > 0


def test_final_model(model_data, tmp_path):
    out = modelling.final_model(model_data, path=str(tmp_path / "m"), folds=2, repeats=1, sizes=[1, 2])
    assert out["sweep"].count() == 99
    best = out["best_threshold"].first()
    assert best["j_index"] == out["sweep"].agg(F.max("j_index")).first()[0]
    assert out["predictions"].count() == model_data.count()
    for name, table in out.items():
        assert table.count() >= 0, name
    assert (tmp_path / "m").exists()


def test_final_model_is_fitted_on_oversampled_rows(spark):
    """One outcome in ten: the fit on oversampled rows calls far more of it than the plain one; the full model has every reduced column."""
    import random

    from riskloom.operators import models as L

    rng, rows = random.Random(5), []
    for i in range(600):
        fail = i % 10 == 0
        rows.append((i, "fail" if fail else "pass", ["Bulk", "RoRo", "Cargo"][i % 3], rng.gauss(10 + 1.5 * fail, 2), rng.gauss(300 + 150 * fail, 150), *[rng.gauss(5, 2) for _ in range(7)]))
    names = ["av_speed", "time_since_af", *[c for c in modelling.FULL_MODEL if c not in modelling.FINAL_MODEL]]
    df = spark.createDataFrame(rows, "vessel_number long, crms string, type string, " + ", ".join(f"{c} double" for c in names))
    out = modelling.final_model(df, folds=2, repeats=1, sizes=[1, 2])
    called = out["predictions"].where("pred = 'fail'").count()
    plain = L.predict_table(L.fit_logistic(df, "crms", "fail", modelling.FINAL_MODEL, scale=True), df, "fail", "pass").where("pred = 'fail'").count()
    assert called > 2 * plain
    terms = {r["term"] for r in out["full_coefficients"].collect()}
    assert {"type_Cargo", "type_RoRo", "hull_works_since_af_x"} <= terms
    assert abs(sum(r["percent"] for r in out["resample_matrix_average"].collect()) - 100) < 1e-9
    assert out["elimination"].agg(F.max("size")).first()[0] == 9
