"""Field-sample jobs: prepare, check, community report, status grids, internal samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import text as X
from riskloom.functions.columns import ref
from riskloom.functions.numeric import richness, row_sum, to_number
from riskloom.functions.tails import f_tail_col
from riskloom.operators import association as T
from riskloom.operators import community as E
from riskloom.operators import figures as V
from riskloom.operators import prepare as P
from riskloom.operators import profile as A
from riskloom.operators.roc import to_series
from riskloom.sources.tables import write_table

# Spelling fixes, subarea -> area, single-sample corrections.
VESSEL_FIXES = {"Maersk Garrone": "Maersk Garonne", "Alycone": "Alcyone", "Seaspan": "Seaspan Hamburg"}
AREA_OF_SUBAREA = {
    "Bilge keel": "Bilge keel",
    "Bow thruster": "Thruster",
    "Bulbous bow": "Bulbous bow",
    "Stern thruster": "Thruster",
    "ICCP": "Anode",
    "Dock block": "DDSS",
    "Dock blocks": "DDSS",
    "Draft marks": "Hull",
    "Hull": "Hull",
    "Transducer": "Other",
    "Propeller": "Propeller and shaft",
    "Propeller blade": "Propeller and shaft",
    "Propeller boss": "Propeller and shaft",
    "Propeller shad": "Propeller and shaft",
    "Propeller shaft": "Propeller and shaft",
    "Rope guard": "Propeller and shaft",
    "Rudder": "Rudder and shaft",
    "Rudder B": "Rudder and shaft",
    "Rudder H": "Rudder and shaft",
    "Rudder L": "Rudder and shaft",
    "Rudder S": "Rudder and shaft",
    "Rudder T": "Rudder and shaft",
    "Rudder Tr": "Rudder and shaft",
    "Sea chest": "Sea chest gratings",
    "Stern arch": "Propeller and shaft",
    "Thruster": "Thruster",
}
COVER_FROM_FILM = "XING ZHI HAI_Rope guard_Niche_NA_Stern_NA_1"
BAD_SAMPLE = "CAP CAPRICORN_Rope guard_Niche_NA_Stern_NA_NA"
RENAMED = {
    "vessel": "vessel_code", "lo_f": "LoF", "side_port_stbd": "side", "region_st_mid_bow": "region",
    "area_8": "subarea", "area_32": "area_type",
}


def vessel_outcomes(tracking: DataFrame) -> DataFrame:
    """Vessel name (title case, spelling fixed) and outcome."""
    name = X.recode(X.title_case(ref("Name")), VESSEL_FIXES)
    return tracking.select(name.alias("vessel"), ref("Pass/Fail").alias("crms"))


def prepare_samples(raw: DataFrame, outcomes: DataFrame, path: str | None = None) -> DataFrame:
    """Raw samples -> clean table with area groups, outcome, repaired covers and richness."""
    df = C.clean_names(raw).withColumn("vessel", X.title_case(ref("vessel")))
    # Rows are filtered ahead of the join, so the join only sees what is kept.
    df = df.where((ref("area_8") != "ISea chest") & (ref("area_sampled") == "TRUE"))
    df = df.withColumns(
        {
            "area": X.recode(ref("area_8"), AREA_OF_SUBAREA),
            "crab": F.when(ref("mobiles_write_in") == "Crab", 1.0).otherwise(0.0),
            "gastropod": F.when(ref("mobiles_write_in") == "Whelks?", 1.0).otherwise(0.0),
        }
    ).drop("mobiles_write_in")
    df = P.lookup_join(df, outcomes, "vessel").withColumnsRenamed(RENAMED)
    df = df.where(ref("sample_id") != BAD_SAMPLE)
    clean, film = ref("clean_hull"), ref("biofilm")
    cover, rating = ref("macro_percent_cover"), ref("LoF")
    repaired, _ = P.backfill_clean(clean, film, cover, rating)
    df = df.withColumn("clean_hull", repaired)
    df = df.withColumn("clean_hull", F.when(ref("sample_id") == COVER_FROM_FILM, cover + film).otherwise(ref("clean_hull")))
    df = df.withColumns(
        {
            "biofilm": F.when(film.isNull() & (ref("clean_hull") == 100), 0.0).otherwise(film),
            "subarea": X.collapse(ref("subarea"), "DDSS", ["Dock block", "Dock blocks"]),
            "type": X.sentence_case(X.recode(ref("type"), {"reefer": "container"})),
            "region": X.recode(ref("region"), {"Mid": "Midships"}),
            "hull_depth": X.recode(ref("hull_depth"), {"FB": "Flat bottom"}),
        }
    )
    df = C.relocate(df, ["crab", "gastropod"], after="ascidians")
    df = C.relocate(df, "area", before="subarea")
    df = C.relocate(df, "crms", after="caw_risk_score")
    df = C.relocate(df, "area_type", after="area")
    df = P.fill(df, C.cols_between(df, "gooseneck", "other_organism_45"), 0.0)
    df = C.rename_from(df, {"macro_percent_cover": "% cover", "highest_fr_rating": "FR rating"})
    taxa = [ref(c) for c in C.cols_between(df, "gooseneck", "other")]
    df = C.relocate(df.withColumn("Richness", richness(taxa)), "Richness", after="FR rating")
    return df if path is None else write_table(df, path)


def quality_report(df: DataFrame, levels: Sequence[str], key: str, measures: Sequence[str]) -> dict[str, DataFrame]:
    """Level tables, null counts, summaries and repeated keys of a cleaned table."""
    out = {f"levels {c}": A.freq_table(df, c) for c in levels}
    out["nulls"] = A.null_profile(df)
    out["summary"] = A.summary_stats(df, measures)
    out["duplicates"] = A.duplicate_keys(df, [key])
    bins = to_series(df, measures, [])
    out["bins"] = V.hist_bins(bins, "value", 10, ["name"])
    return out


def responses(df: DataFrame) -> DataFrame:
    """Long form of the response measures."""
    keys = ["vessel_code", "type", "crms", "area", "subarea", "side", "region", "hull_depth", "caw_risk_score", "category"]
    return to_series(df, C.cols_between(df, "% cover", "Richness"), [k for k in keys if k in df.columns])


def community_report(df: DataFrame, permutations: int = 999, seed: int = 1) -> dict[str, DataFrame]:
    """Field-data profile and community analyses."""
    long = responses(df)
    per_area = A.unit_means(long, ["vessel_code", "type", "crms", "area", "name"], ["value"])
    taxa = C.cols_between(df, "clean_hull", "other")
    sites = E.site_means(df, ["vessel_code", "type", "crms"], taxa)
    present = E.presence_table(sites, taxa)
    shares = A.unit_means(df, ["vessel_code", "type", "area", "crms"], taxa)
    taxa_long = to_series(shares, taxa, ["vessel_code", "type", "area", "crms"])
    names = {"Fil_green_algae": "Green fil. algae", "Macro_algae": "Macroalgae", "Clean_hull": "Clean hull"}
    taxa_long = taxa_long.withColumn("name", X.recode(X.sentence_case(ref("name")), names))
    by_bar = A.unit_means(taxa_long, ["crms", "type", "name"], ["value"])
    out = {
        "correlation": T.corr_matrix(df, C.cols_between(df, "% cover", "Richness")),
        "vessels_by_type": A.freq_table(df.select("vessel_code", "type").distinct(), "type"),
        "response_bins": V.hist_bins(long, "value", 8, ["name"], ["crms"]),
        "response_summary": A.group_moments(long, ["name", "crms"], "value"),
        "sample_counts": V.count_bars(df, ["area", "subarea", "type"]),
        "unit_summary": A.group_moments(per_area, ["name", "crms"], "value"),
        "area_summary": A.group_moments(per_area, ["name", "area"], "value").orderBy("name", F.desc_nulls_last("mean")),
        "boxes_type": V.box_stats(per_area, "value", ["name", "type", "crms"]),
        "boxes_area": V.box_stats(per_area, "value", ["name", "area", "crms"]),
        "boxes_subarea": V.box_stats(long, "value", ["name", "area", "subarea"]),
        "boxes_depth": V.box_stats(long.na.drop(subset=["hull_depth"]), "value", ["name", "hull_depth"]),
        "boxes_score": V.box_stats(long, "value", ["name", "caw_risk_score"]),
        "boxes_crms": V.box_stats(long, "value", ["name", "crms"]),
        "boxes_category": V.box_stats(long, "value", ["name", "category"]),
        "taxa_boxes": V.box_stats(taxa_long, "value", ["type", "name", "crms"]),
        "taxa_share": V.mean_share(by_bar, ["crms", "type"], "name", "value"),
        "taxa_summary": A.group_se_ci(taxa_long, ["name", "crms"], "value").orderBy("crms", F.desc_nulls_last("mean")),
        "permanova": E.permanova_terms(present, taxa, ["crms", "type"], permutations=permutations, seed=seed),
        "indicator_taxa": E.indicator_test(sites, taxa, ["vessel_code"], "crms", permutations, seed),
        "ordination": E.ordination(present, taxa, ["vessel_code", "type", "crms"]),
    }
    for side in ("side", "region"):
        part = A.unit_means(long, ["vessel_code", "type", "crms", "area", side, "name"], ["value"]).na.drop(subset=[side])
        out[f"boxes_{side}"] = V.box_stats(part, "value", ["name", side, "crms"])
    for group in ("type", "crms"):
        spread = T.anova_one_way(E.median_distances(present, taxa, group), "dist", group)
        p = f_tail_col("f", ref("df_between").cast("double"), ref("df_within").cast("double"))
        out[f"dispersion_{group}"] = spread.withColumn("p", p)
    return out


def status_report(df: DataFrame, criteria: DataFrame) -> dict[str, DataFrame]:
    """Fail/pass by unit and area, by criterion, and the failing share per area."""
    flags = C.cols_between(df, "green_algae_50mm_length", "other_organism_45")
    numbers = P.numbered(df.select("vessel_code"), "vessel_code", "vessel_no")
    by_area = A.unit_status(df, ["vessel_code", "type"], ["area", "subarea"], flags)
    by_area = P.lookup_join(by_area, numbers, "vessel_code")
    by_criterion = A.unit_means(to_series(df, flags, ["vessel_code", "type"]), ["vessel_code", "type", "name"], ["value"])
    by_criterion = P.lookup_join(by_criterion.withColumnRenamed("value", "mean_value"), criteria, {"name": "value"})
    by_sum = A.unit_status_sum(df, ["vessel_code"], ["subarea"], flags)
    return {
        "status": by_area,
        "grid_subarea": V.heat_grid(by_area, "vessel_code", "subarea", "mean_area", "fail_prop"),
        "grid_area": V.heat_grid(by_area, "vessel_code", "area", "mean_area", "fail_prop"),
        "criteria": P.lookup_join(by_criterion, numbers, "vessel_code"),
        "status_bars": V.stacked_share(by_sum, [], "vessel_code", "status"),
        "status_sums": by_sum,
        "area_ranking": A.area_ranking(by_sum, ["subarea"]),
    }


def prepare_internals(raw: DataFrame) -> DataFrame:
    """Internal (endoscope) samples: numbers repaired, sea-chest rows kept, taxa summed."""
    df = C.clean_names(raw)
    df = C.across(df, df.columns[14:35], to_number)
    df = df.where((ref("inside_grate") == "TRUE") & (ref("area") == "seachest"))
    df = df.select("vessel_id", "rrisk", *[ref(c) for c in C.cols_between(df, "macro_cover", "pass_fail_i")])
    # Taxa that make up the diversity score.
    taxa = [
        "gooseneck", "fil_green_algae", "macroalgae", "barnacles", "tubeworms", "bryozoans",
        "bivalves", "hydroids", "anemones", "ascidians", "othersp",
    ]
    return df.withColumn("taxa_diversity", row_sum([ref(c) for c in taxa]))


def internals_as_text(df: DataFrame) -> DataFrame:
    """Identifiers as text of their number, diversity over the whole taxa range."""
    ids = {c: to_number(ref(c).cast("string")).cast("string") for c in ("rrisk", "vessel_id")}
    taxa = [ref(c) for c in C.cols_between(df, "gooseneck", "mobiles")]
    return df.withColumns(ids).withColumn("taxa_diversity", row_sum(taxa))
