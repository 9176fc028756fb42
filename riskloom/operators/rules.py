"""Rule-based indicators: typed rules, first match wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of a rule table, conditions in SQL.

    ``match`` picks the type; ``typed`` conditions hold for that type. ``open`` conditions were
    written behind an OR without brackets and so hold for every type, unless the table is applied
    with ``bracketed=True``.
    """

    match: str = "true"
    typed: str = "true"
    open: str | None = None
    outcome: str = "fail"

    def predicate(self, bracketed: bool = False) -> str:
        if self.open is None:
            return f"({self.match}) AND ({self.typed})"
        if bracketed:
            return f"({self.match}) AND (({self.typed}) OR ({self.open}))"
        return f"(({self.match}) AND ({self.typed})) OR ({self.open})"


# Thresholds and type names of the published indicator sets.
RULES_2017 = (
    Rule("type RLIKE 'Bulk|Tanker'", "time_since_owm > 260 OR time_since_af > 260", "laid_up_more_10d > 0 AND ports_12m > 35"),
    Rule("type = 'Container'", "time_since_owm > 550", "time_since_survey > 200 AND time_since_af > 500"),
    Rule("type = 'RoRo'", "time_since_owm > 230 OR time_since_af > 230 OR ports_12m > 80"),
    Rule("type = 'Passenger'", "time_since_owm > 230 OR time_since_af > 320 OR laid_up_more_10d > 0 OR max_lu_12m > 5"),
)
RULES_2021 = (
    Rule("type = 'Bulker/Tanker'", "time_since_af > 324", "laid_up_more_10d > 0 OR time_since_owm > 324 OR av_speed < 12"),
    Rule("type = 'Container'", "time_since_af > 550", "time_since_owm > 569"),
    Rule("type = 'RoRo'", "time_since_af > 363", "time_since_owm > 363 OR time_since_survey > 329"),
    Rule("type = 'Passenger'", "time_since_af > 437", "time_since_owm > 270"),
)
RULES_MERGED = (
    Rule("type = 'Bulker/Tanker'", "time_since_af > 450", "NPorts > 47"),
    Rule("type = 'Cargo'", "time_since_af > 340"),
    Rule("type = 'RoRo'", "time_since_af > 320", "NPorts > 32"),
    Rule("type = 'Passenger'", "time_since_af > 370", "MMDays > 2"),
)
RULES_MERGED_COATING = (
    Rule("type = 'Bulker/Tanker'", "time_since_af > 324"),
    Rule("type = 'Container'", "time_since_af > 550"),
    Rule("type = 'RoRo'", "time_since_af > 363"),
    Rule("type = 'Passenger'", "time_since_af > 437"),
)
COATING_DAYS = 342
SCORE_LIMIT = 1


def rule_column(rules: Iterable[Rule], default: str = "pass", bracketed: bool = False) -> Column:
    """Outcome of the first rule that is true; an unknown condition counts as not true."""
    chain = None
    for rule in rules:
        test, outcome = F.expr(rule.predicate(bracketed)), F.lit(rule.outcome)
        chain = F.when(test, outcome) if chain is None else chain.when(test, outcome)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def apply_rules(df: DataFrame, rules: Sequence[Rule], out: str, default: str = "pass", bracketed: bool = False) -> DataFrame:
    return df.withColumn(out, rule_column(rules, default, bracketed))


def apply_rule_table(df: DataFrame, table: DataFrame, out: str, default: str = "pass") -> DataFrame:
    """Rules kept as a table (ord, predicate, outcome), compiled into one expression."""
    lines = table.select("ord", "predicate", "outcome").orderBy("ord").collect()
    return apply_rules(df, [Rule(typed=r["predicate"], outcome=r["outcome"]) for r in lines], out, default)


def threshold_rule(
    df: DataFrame, score: str, above: float, out: str, yes: str = "fail", no: str = "pass"
) -> DataFrame:
    """``yes`` when the score is above the limit, ``no`` when not, null when unknown."""
    test = F.col(score) > F.lit(above)
    return df.withColumn(out, F.when(test, F.lit(yes)).when(~test, F.lit(no)))


def rules_2017(df: DataFrame, out: str = "pred_17", bracketed: bool = False) -> DataFrame:
    return apply_rules(df, RULES_2017, out, bracketed=bracketed)


def rules_2021(df: DataFrame, out: str = "pred_21", bracketed: bool = False) -> DataFrame:
    return apply_rules(df, RULES_2021, out, bracketed=bracketed)


def rules_2021_simple(df: DataFrame, out: str = "pred_21_simple") -> DataFrame:
    return threshold_rule(df, "time_since_af", COATING_DAYS, out)


def rules_merged(df: DataFrame, bracketed: bool = False) -> DataFrame:
    """Both variants for the merged data, and the single threshold."""
    out = apply_rules(df, RULES_MERGED, "pred_21", bracketed=bracketed)
    return rules_2021_simple(apply_rules(out, RULES_MERGED_COATING, "pred_21a", bracketed=bracketed))
