"""Indicator jobs: validate scores and rule sets, screen predictors, merge sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import text as X
from riskloom.functions.columns import ref
from riskloom.operators import confusion as M
from riskloom.operators import figures as V
from riskloom.operators import models as L
from riskloom.operators import prepare as P
from riskloom.operators import profile as A
from riskloom.operators import roc as R
from riskloom.operators import rules as D
from riskloom.sources.tables import write_table

# Merged types and display names.
BULK_TANKER = {"Bulk": "Bulk/Tanker", "Tanker": "Bulk/Tanker"}
CARGO = {"Container": "Cargo", "Reefer": "Cargo", "Cargo": "Cargo"} | BULK_TANKER
MERGED_LABELS = {
    "NPorts": "Ports since last AF/DD",
    "MMDays": "Duration of lay-up (d)",
    "PortDays": "Mean days in port",
    "time_since_af": "Time since AF",
}
PROVIDERS = ["KML", "NZD"]


def validate_score(tracking: DataFrame) -> dict[str, DataFrame]:
    """Test an existing ordinal risk score (``mpi_c``) against the inspection outcome."""
    df = tracking.withColumn("crms", F.lower(ref("Pass/Fail"))).drop("Pass/Fail")
    df = C.relocate(df, "crms", after="Caw c")
    df = C.clean_names(df.select(*[ref(c) for c in C.cols_between(df, df.columns[0], "Areas failing")]))
    df = D.threshold_rule(df, "mpi_c", D.SCORE_LIMIT, "mpi_pred")
    cells = M.confusion(df, "crms", "mpi_pred", "fail")
    kept = ["type", "crms", "mpi_c", "mpi_pred"]
    if {"age_of_antifoul_when_sampled", "lay_up_period_in_last_12_months"} <= set(df.columns):
        kept += C.cols_between(df, "age_of_antifoul_when_sampled", "lay_up_period_in_last_12_months")
    return {
        "classes": A.group_share(df, ["crms"]),
        "roc": R.roc_curve(df, "crms", "mpi_c", "fail"),
        "auc": R.auc(df, "crms", "mpi_c", "fail"),
        "misclassified": M.misclassified(df, "crms", "mpi_pred", kept),
        "matrix": M.confusion_cells(cells, "fail", "pass"),
        "metrics": M.class_metrics(df, "crms", "mpi_pred", "fail"),
        "statistics": M.tidy_statistics(M.matrix_statistics(df, "crms", "mpi_pred", "fail")),
    }


def screen_predictors(model_data: DataFrame, labels: DataFrame, event: str = "fail") -> dict[str, DataFrame]:
    """ROC of every single predictor, overall and by type."""
    df = model_data.withColumn("type", X.recode(ref("type"), BULK_TANKER))
    series = R.to_series(df, C.cols_between(df, "tonnage_dwt", "time_since_owm"), ["crms", "type"])
    overall = R.roc_summary(series, "crms", "value", event, ["name"])
    by_type = R.roc_summary(series, "crms", "value", event, ["name", "type"], tie="farthest", one_row=True)
    return {
        "summary": overall,
        "report": R.report_table(overall, labels),
        "curves": R.roc_curve(series, "crms", "value", event, ["name"]),
        "summary_by_type": by_type,
        "report_by_type": R.report_table(by_type, labels),
        "curves_by_type": R.roc_curve(series, "crms", "value", event, ["name", "type"]),
        "strong_by_type": by_type.where(ref("auc") > 0.7),
    }


def merge_sources(voyages: DataFrame, outcomes: DataFrame, model_data: DataFrame, path: str | None = None) -> DataFrame:
    """Voyage histories with a known outcome, stacked on the model table; types merged."""
    kept = voyages.where(ref("Provider").isin(*PROVIDERS))
    kept = kept.select(X.strip_all(ref("QuesCode"), "-").alias("vessel_code"), "AFInt", "NPorts", "MMDays", "PortDays")
    kept = P.lookup_join(kept, outcomes.select("vessel_code", "vessel_type", "crms"), "vessel_code")
    kept = C.rename_from(kept, {"AFInt": "time_since_af", "vessel_type": "type"}).na.drop(subset=["crms", "time_since_af"])
    both = kept.unionByName(model_data, allowMissingColumns=True)
    both = both.withColumn("type", X.recode(ref("type"), CARGO))
    return both if path is None else write_table(both, path)


def screen_merged(all_data: DataFrame, event: str = "fail", points: int = 250) -> dict[str, DataFrame]:
    """Counts, ROC screening, stepwise logistic model and response curve on the merged data."""
    columns = C.cols_between(all_data, "time_since_af", "PortDays")
    series = R.to_series(all_data, columns, ["crms", "type"])
    overall = R.roc_summary(series, "crms", "value", event, ["name"], tie="farthest")
    by_type = R.roc_summary(series, "crms", "value", event, ["name", "type"], tie="farthest", one_row=True)
    kept, path = L.step_aic(all_data, "crms", event, ["time_since_af", "type"])
    spark = all_data.sparkSession
    out = {
        "rows": all_data.agg(F.count(F.lit(1)).alias("n")),
        "counts": A.count_by(all_data, ["type", "crms"]),
        "bins": V.hist_bins(all_data, "time_since_af", 15, [], ["type"]),
        "summary": overall,
        "report": R.report_table(overall).withColumn("name", X.recode(ref("name"), MERGED_LABELS)),
        "curves": R.roc_curve(series, "crms", "value", event, ["name"]),
        "summary_by_type": by_type,
        "curves_by_type": R.roc_curve(series, "crms", "value", event, ["name", "type"]),
        "selection": path,
    }
    if kept:
        model = L.fit_logistic(all_data, "crms", event, kept)
        out["coefficients"] = L.coefficients(model, spark, odds=True)
        if "time_since_af" in kept:
            out["response"] = L.partial_dependence(model, all_data.na.drop(subset=kept), "time_since_af", points)
    return out


def validate_rule_sets(model_data: DataFrame, all_data: DataFrame, event: str = "fail") -> dict[str, DataFrame]:
    """Every rule set against the outcome: the 2017 set on 2021 data, the others on all rows."""
    df = model_data.withColumn("type", X.recode(ref("type"), BULK_TANKER))
    runs: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame], str]] = {
        "rules_2017": (df.where(ref("dataset") == "quest_21"), D.rules_2017, "pred_17"),
        "rules_2021": (df, D.rules_2021, "pred_21"),
        "rules_2021_simple": (df, D.rules_2021_simple, "pred_21_simple"),
        "merged": (all_data, D.rules_merged, "pred_21"),
        "merged_coating": (all_data, D.rules_merged, "pred_21a"),
        "merged_simple": (all_data, D.rules_merged, "pred_21_simple"),
    }
    out = {}
    for name, (rows, rule, label) in runs.items():
        stats = M.validate_rules(rows, rule, "crms", label, event)
        out[name] = M.tidy_statistics(stats)
        out[f"{name} matrix"] = M.confusion_cells(stats.select(*M.CELLS), event, "pass")
    out["misclassified"] = M.misclassified(D.rules_2021(df), "crms", "pred_21")
    return out
