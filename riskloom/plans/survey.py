"""Questionnaire jobs: prepare, stack survey years, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import text as X
from riskloom.functions.columns import ref
from riskloom.functions.dates import days_between, days_or
from riskloom.operators import association as T
from riskloom.operators import figures as V
from riskloom.operators import prepare as P
from riskloom.operators import profile as A
from riskloom.operators.resample import impute_trees
from riskloom.operators.roc import to_series
from riskloom.sources.tables import write_table

# Labels merged, and bands in their order.
TYPE_2021 = {"Reefer": "Container"}
TYPE_MODEL = {"General Cargo": "Container"}
HULL_PROTECTION = {"Pure Epoxy based Anti-Corrosive Paint for Shell (High Solid type)": "Other"}
INTAKE_FREQUENCY = {
    "Once a month": "Every 1 - 3 months",
    "Every 2 months": "Every 1 - 3 months",
    "Every 3 months": "Every 1 - 3 months",
    "Every 1 - 2 months": "Every 1 - 3 months",
    "During underwater inspection": "Every 3 - 6 months",
    "Regularly": "Every 1 - 3 months",
    "Continously": "Every 1 - 3 months",
}
VISIT_BANDS = ["0", "1 - 5", "6 - 10", "11 - 20", "21 - 50", ">50"]
AF_APPLIED = {"All hull and niche areas": "All areas"}


def align_questions(form: DataFrame, mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    """Question names of the 2021 form beside those of 2017; mapping rows without one are dropped."""
    named = C.rename_from(form.select(*[ref(c) for c in dict.fromkeys([form.columns[0], *on])]), {form.columns[0]: "name_2021"})
    keys = ["name_2021" if c == form.columns[0] else c for c in on]
    return P.align(named, mapping, keys, ["name_2021"])


def prepare_questionnaire(raw: DataFrame, alignment: DataFrame, outcomes: DataFrame, path: str | None = None) -> DataFrame:
    """Raw 2021 form -> clean table: aligned names, day counts, outcome, recoded answers."""
    df = C.rename_from(C.drop_at(raw, 0, 1, 2, 3, 4), alignment, "name_2021", "question_17")
    q = {n: ref(C.question(df, n)) for n in (2, 27, 28, 43, 47, 53, 54, 56, 57, 63)}
    arrival = q[2]
    df = df.withColumns(
        {
            "Time_since_survey": days_between(arrival, ref("Last_class_survey")),
            "Time_since_AF": days_between(arrival, q[27]),
            "Time_since_OWM": days_between(arrival, ref("Last out-of-water maintenance date")),
            "Multi_AF": X.if_known(q[28] > 1, "Yes", "No"),
        }
    )
    status = C.rename_from(outcomes, {outcomes.columns[0]: "Vessel number", "Pass/Fail": "crms"})
    df = P.lookup_join(df, status.select(ref("Vessel number"), "crms"), "Vessel number")
    band = q[47]
    df = df.withColumns(
        {
            "crms": X.sentence_case(ref("crms")),
            "Cleaning_since_AF": X.yes_no(ref("Cleaning_since_AF")),
            "Hull_works_since_AF": X.yes_no(ref("Hull_works_since_AF")),
            "time_since_cleaning": days_or(arrival, q[43], ref("Time_since_AF")),
            "Port_of_registration": X.sentence_case(ref("Port_of_registration")),
            "Type": X.recode(ref("Type"), TYPE_2021),
            "Hull protection": X.recode(ref("Hull protection"), HULL_PROTECTION),
            "no_idle_days": days_between(q[54], q[53]),
            "time_since_idle": days_between(arrival, q[54]),
            "time_since_last_port": days_between(arrival, q[57]),
            "time_in_last_port": days_between(q[57], q[56]),
            "time_since_last_inspection": days_between(arrival, q[63]),
            "Regular_intake_treatment": X.recode(ref("Regular_intake_treatment"), INTAKE_FREQUENCY),
            "ports_since_owm": band,
            "ports_since_owm_ord": X.level_rank(band, VISIT_BANDS),
            "Set_route": X.sentence_case(ref("Set_route")),
            "AF_applied": X.sentence_case(F.trim(F.lower(ref("AF_applied")))),
        }
    )
    return df if path is None else write_table(df, path)


def stack_surveys(quest_21: DataFrame, quest_17: DataFrame, path: str | None = None, impute: bool = True) -> tuple[DataFrame, DataFrame]:
    """(model table, its null counts before filling) from both survey years."""
    older = C.rename_from(quest_17, {"Nr": "Vessel number", "LOF_fail_mpi": "crms"})
    older = P.fill(older, ["Cleaning_since_AF"], "No")
    both = P.stack({"quest_21": quest_21, "quest_17": older}, "Dataset")
    picked = both.select(
        ref("Vessel number"), "Dataset", "crms", "Type",
        *[ref(c) for c in C.cols_between(quest_21, "Tonnage_DWT", "Max_speed")],
        *[ref(c) for c in C.cols_between(quest_21, "Ports_12m", "Max_LU_12m")],
        *[ref(c) for c in C.cols_between(quest_21, "Time_since_survey", "Time_since_OWM")],
        "Cleaning_since_AF", "Hull_works_since_AF",
    )
    flags = {c: X.if_known(ref(c) == "Yes", 1, 0) for c in ("Cleaning_since_AF", "Hull_works_since_AF")}
    picked = picked.withColumns(flags | {"crms": F.lower("crms"), "Type": X.recode(ref("Type"), TYPE_MODEL)})
    clean = C.clean_names(picked).where(ref("type") != "Fishing")
    gaps = A.null_profile(clean, only_gaps=True)
    if impute:
        numbers = [c for c in C.cols_where(clean, numeric=True) if c != "vessel_number"]
        clean = impute_trees(clean, numbers, ["crms", "type"])
    return (clean if path is None else write_table(clean, path)), gaps


def profile_questionnaire(q: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the questionnaire report, one DataFrame each."""
    ids = [c for c in ("Type", "crms") if c in q.columns]
    traits = to_series(q, C.cols_between(q, "Tonnage_DWT", "Max_speed"), ids)
    care = to_series(q, C.cols_between(q, "Time_since_survey", "Time_since_OWM"), ids)
    roots = traits.withColumn("value", F.sqrt("value"))
    out = {
        "crms": A.group_share(q, ["crms"]),
        "crms_by_type": A.group_share(q, ["Type", "crms"], ["Type"]),
        "crms_bars": V.stacked_share(q, [], "Type", "crms"),
        "arrival_range": A.column_range(q, C.question(q, 2)),
        "chartered": A.crosstab(q, C.question(q, 14), "Type"),
        "trait_bins": V.hist_bins(traits, "value", 10, ["name"], ["Type"]),
        "trait_boxes": V.box_stats(traits, "value", ["name", "Type", "crms"]),
        "trait_summary": A.group_min_med_max(traits, ["name"], "value"),
        "trait_summary_by_type": A.group_min_med_max(traits, ["name", "Type"], "value"),
        "trait_anova": T.anova_two_way(roots, "value", "Type", "crms", ["name"]),
        "care_bins": V.hist_bins(care, "value", 10, ["name"]),
        "care_boxes": V.box_stats(care, "value", ["name", "Type", "crms"]),
        "care_summary": A.group_moments(care, ["name", "crms"], "value").withColumn("ci", ref("se") * 1.96),
        "care_anova": T.anova_two_way(care, "value", "Type", "crms", ["name"]),
        "care_scatter": q.select("Time_since_OWM", "Time_since_AF", *ids),
        "care_correlation": T.corr_matrix(q, ["Time_since_OWM", "Time_since_AF"], use="pairwise"),
    }
    one_way = [C.question(q, 1), "Time_in_NZ", "Type", "Port_of_registration", "BF_management_plan", "Aware_of_IMO_BFG"]
    for c in one_way:
        if c in q.columns:
            out[f"freq {c}"] = A.freq_table(q, c)
    answers = [
        "AF_applied", "Hull protection", "MGSP", "Intake_treatment", "Regular_intake_treatment", "Cleaning_since_AF",
        "Hull_works_since_AF", "Multi_AF", "Set_route", "ports_since_owm", C.question(q, 48), C.question(q, 44), C.question(q, 45),
    ]
    q = q.withColumn("AF_applied", X.recode(ref("AF_applied"), AF_APPLIED))
    for c in answers:
        if c not in q.columns:
            continue
        out[f"bars {c}"] = V.stacked_share(q.na.drop(subset=[c]), ["crms"], "Type", c)
        out[f"table {c}"] = A.crosstab(q, c, "crms")
        out[f"share {c}"] = A.group_share(q, ["crms", c], ["crms"])
        out[f"share by type {c}"] = A.group_share(q, ["Type", "crms", c], ["Type", "crms"])
        out[f"fisher {c}"] = T.fisher_rxc(q, c, "crms", show_na=c == "ports_since_owm")
    last = to_series(q, ["time_since_last_port", "time_in_last_port", "no_idle_days", "time_since_idle"], ids)
    out["voyage_boxes"] = V.box_stats(last, "value", ["name", "Type", "crms"])
    out["voyage_anova"] = T.anova_two_way(last, "value", "Type", "crms", ["name"], interaction=False)
    place = q.select(X.after_last_comma(ref(C.question(q, 52))).alias("country"))
    out["anchorage_country"] = A.count_by(place.withColumn("country", F.trim("country")), ["country"]).orderBy(F.desc("n"), "country")
    out["inspection"] = q.select("Inspection", ref(C.question(q, 62)).alias("outcome")).distinct()
    out["inspection_boxes"] = V.box_stats(q.where(ref("time_since_last_inspection").isNotNull()), "time_since_last_inspection", ["Type"])
    return out
