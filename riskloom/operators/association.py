"""Correlation, analysis of variance and exact tests.

Every statistic is computed from sufficient counts or moments that Spark aggregates; numpy only
sees one small block of cells per variable or table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.functions.columns import ref
from riskloom.functions.numeric import half_even
from riskloom.operators.small import attach


def corr_matrix(
    df: DataFrame, columns: Sequence[str], use: str = "everything", digits: int | None = None
) -> DataFrame:
    """Long Pearson matrix (var1, var2, n, r), all pairs in one aggregation.

    ``use``: ``"everything"`` gives null for a pair with any null, ``"complete"`` drops rows with a
    null in any column, ``"pairwise"`` drops them per pair.
    """
    rows = df.select(*[ref(c).cast("double").alias(c) for c in columns])
    if use == "complete":
        rows = rows.na.drop()
    pairs = list(combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = ref(a).isNotNull() & ref(b).isNotNull()
        n = F.sum(both.cast("long"))
        r = F.corr(F.when(both, ref(a)), F.when(both, ref(b)))
        if use == "everything":
            r = F.when(n == F.count(F.lit(1)), r)
        aggs += [r.alias(f"_r{i}"), n.alias(f"_n{i}")]
    for i, c in enumerate(columns):
        aggs += [F.count(ref(c)).alias(f"_m{i}"), F.count(F.lit(1)).alias(f"_t{i}")]
    wide = rows.agg(*aggs)

    def cell(a: str, b: str, r: Column, n: Column) -> Column:
        return F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), n.alias("n"), r.alias("r"))

    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(cell(x, y, ref(f"_r{i}"), ref(f"_n{i}")))
    for i, c in enumerate(columns):
        whole = ref(f"_m{i}") == ref(f"_t{i}") if use == "everything" else ref(f"_m{i}") > 0
        cells.append(cell(c, c, F.when(whole, F.lit(1.0)), ref(f"_m{i}")))
    out = wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return out if digits is None else out.withColumn("r", half_even(ref("r"), digits))


def corr_pvalues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sided p of every pair, pairwise complete; 0 on the diagonal."""
    table = corr_matrix(df, columns, use="pairwise")
    free = ref("n") - 2
    clipped = F.greatest(1 - ref("r") * ref("r"), F.lit(0.0))
    t = F.when(clipped > 0, F.abs(ref("r")) * F.sqrt(free / F.nullif(clipped, F.lit(0.0)))).otherwise(F.lit(float("inf")))
    p = F.when(ref("var1") == ref("var2"), F.lit(0.0)).when(free > 0, tails.t_tail_col(t, free.cast("double")))
    return table.withColumn("p", p)


def drop_correlated(df: DataFrame, columns: Sequence[str], cutoff: float = 0.8, digits: int | None = 2) -> list[str]:
    """Columns to drop so that no pair stays above the cutoff.

    Columns are visited from the largest mean absolute correlation down. Of a pair above the cutoff the
    first goes when its mean exceeds the mean of all correlations of columns other than the second, else the second;
    means are over the columns still in. The matrix is one small row.
    """
    size = len(columns)
    place = {c: i for i, c in enumerate(columns)}
    m = np.eye(size)
    for row in corr_matrix(df, columns, use="complete", digits=digits).collect():
        m[place[row["var1"]], place[row["var2"]]] = np.nan if row["r"] is None else row["r"]
    m = np.abs(m)
    np.fill_diagonal(m, np.nan)
    order = np.argsort(-np.nan_to_num(np.nanmean(m, axis=0)), kind="stable")
    live = np.ones(size, dtype=bool)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if live[i] and live[j] and m[i, j] > cutoff:
                others = live.copy()
                others[j] = False
                mean_i, mean_rest = np.nanmean(m[i, live]), np.nanmean(m[np.ix_(others, live)])
                live[i if mean_i > mean_rest else j] = False
    return [c for c in columns if not live[place[c]]]


def anova_one_way(df: DataFrame, value: str, factor: str, by: Sequence[str] = ()) -> DataFrame:
    """df, sums of squares, mean squares and F, all in Spark.

    Cells carry count, mean and spread, so large offsets do not cancel.
    """
    rows = df.where(ref(value).isNotNull() & ref(factor).isNotNull())
    cells = rows.groupBy(*[ref(c) for c in [*by, factor]]).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(ref(value)).alias("_mean"), F.var_pop(ref(value)).alias("_var")
    )
    centre = cells.groupBy(*[ref(c) for c in by]).agg((F.sum(ref("_n") * ref("_mean")) / F.sum("_n")).alias("_centre"))
    out = attach(cells, centre, by).groupBy(*[ref(c) for c in by]).agg(
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("_n") - F.count(F.lit(1))).alias("df_within"),
        F.sum(ref("_n") * F.pow(ref("_mean") - ref("_centre"), F.lit(2.0))).alias("ss_between"),
        F.sum(ref("_n") * ref("_var")).alias("ss_within"),
    )
    ms_between = ref("ss_between") / F.nullif(ref("df_between"), F.lit(0))
    ms_within = ref("ss_within") / F.nullif(ref("df_within"), F.lit(0))
    return out.withColumn("ms_between", ms_between).withColumn("ms_within", ms_within).withColumn(
        "f", ref("ms_between") / F.nullif(ref("ms_within"), F.lit(0.0))
    )


def _sequential(frame: pd.DataFrame, factors: Sequence[str], interaction: bool) -> list[tuple]:
    """Term rows (term, df, sumsq) from cells with columns n, mean, ss.

    The second factor is fitted after the first has been swept out, in a matrix of its levels by its levels; what the
    two leave of the spread between cells is the interaction.
    """
    n = frame["_n"].to_numpy(float)
    y = frame["_mean"].to_numpy(float) - np.average(frame["_mean"], weights=n)
    (a, levels_a), (b, levels_b) = (pd.factorize(frame[f], sort=True) for f in factors)
    between = float(n @ (y * y))
    size_a, size_b = np.bincount(a, n), np.bincount(b, n)
    sum_a, sum_b = np.bincount(a, n * y), np.bincount(b, n * y)
    first = float((sum_a**2 / size_a).sum())
    cross = np.zeros((len(levels_a), len(levels_b)))
    np.add.at(cross, (a, b), n)
    swept = np.diag(size_b) - cross.T @ (cross / size_a[:, None])
    values, vectors = np.linalg.eigh((swept + swept.T) / 2)
    fresh = vectors[:, values > 1e-9 * max(1.0, size_b.max())]
    kept = values[values > 1e-9 * max(1.0, size_b.max())]
    second = float((((sum_b - cross.T @ (sum_a / size_a)) @ fresh) ** 2 / kept).sum())
    rows = [("term1", len(levels_a) - 1, first), ("term2", len(kept), second)]
    used, left = len(levels_a) + len(kept), max(between - first - second, 0.0)
    inside = float(frame["_ss"].sum())
    if interaction:
        rows.append(("term12", len(n) - used, left))
        used, left = len(n), 0.0
    return [*rows, ("Residuals", int(n.sum()) - used, inside + left)]


def anova_two_way(
    df: DataFrame,
    value: str,
    first: str,
    second: str,
    by: Sequence[str] = (),
    interaction: bool = True,
) -> DataFrame:
    """Sequential analysis of variance (term, df, sumsq, meansq, f, p) per ``by`` group.

    The data is one aggregation to (by, first, second) cells; fits run on cells. Empty cells cost
    their degrees of freedom.
    """
    rows = df.where(ref(value).isNotNull() & ref(first).isNotNull() & ref(second).isNotNull())
    group = list(by) or ["_one"]
    rows = rows if by else rows.withColumn("_one", F.lit(0))
    cells = rows.groupBy(*[ref(c) for c in [*group, first, second]]).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(ref(value)).alias("_mean"),
        (F.count(F.lit(1)) * F.var_pop(ref(value))).alias("_ss"),
    )
    names = {"term1": first, "term2": second, "term12": f"{first}:{second}", "Residuals": "Residuals"}
    schema = cells.select(*[ref(c) for c in group]).schema
    for name, kind in (("ord", "integer"), ("term", "string"), ("df", "long"), ("sumsq", "double"), ("_rdf", "long"), ("_rms", "double")):
        schema = schema.add(name, kind)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        found = _sequential(frame, (first, second), interaction)
        out = pd.DataFrame(
            [(i, names[t], d, s) for i, (t, d, s) in enumerate(found)], columns=["ord", "term", "df", "sumsq"]
        )
        _, rest, left = found[-1]
        out["_rdf"], out["_rms"] = rest, left / rest if rest else np.nan
        for position, c in enumerate(group):
            out.insert(position, c, frame[c].iloc[0])
        return out

    table = cells.groupBy(*[ref(c) for c in group]).applyInPandas(fit, schema)
    table = table.withColumn("meansq", ref("sumsq") / F.nullif(ref("df"), F.lit(0)))
    tested = (ref("term") != "Residuals") & (ref("df") > 0) & (ref("_rms") > 0)
    table = table.withColumn("f", F.when(tested, ref("meansq") / ref("_rms")))
    p = tails.f_tail_col(F.coalesce(ref("f"), F.lit(0.0)), F.greatest(ref("df"), F.lit(1)).cast("double"), F.greatest(ref("_rdf"), F.lit(1)).cast("double"))
    table = table.withColumn("p", F.when(ref("f").isNotNull(), p))
    return table.select(*[ref(c) for c in by], "ord", "term", "df", "sumsq", "meansq", "f", "p")


def fisher_2x2(df: DataFrame, row: Column, column: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact test of two yes/no conditions per group: cells a, b, c, d and the two-sided p."""
    rows = df.select(*[ref(c) for c in by], row.alias("_x"), column.alias("_y")).where(ref("_x").isNotNull() & ref("_y").isNotNull())

    def cell(test: Column) -> Column:
        return F.coalesce(F.sum(test.cast("long")), F.lit(0).cast("long"))

    x, y = ref("_x"), ref("_y")
    cells = rows.groupBy(*[ref(c) for c in by]).agg(
        cell(x & y).alias("a"), cell(x & ~y).alias("b"), cell(~x & y).alias("c"), cell(~x & ~y).alias("d")
    )
    return cells.withColumn("p", tails.fisher_col("a", "b", "c", "d"))


def fisher_rxc(
    df: DataFrame,
    row: str,
    column: str,
    by: Sequence[str] = (),
    replicates: int = 1999,
    chunks: int = 16,
    seed: int = 1,
    show_na: bool = False,
) -> DataFrame:
    """Monte-Carlo form of the exact test for tables of any shape: (by, n, exceed, replicates, p).

    The data is one count by cell. Replicate tables are drawn from the margins, not from the rows,
    and split over ``chunks`` tasks per table, so the work per replicate does not grow with the data.
    """
    group = list(by) or ["_one"]
    rows = df if by else df.withColumn("_one", F.lit(0))
    if not show_na:
        rows = rows.where(ref(row).isNotNull() & ref(column).isNotNull())
    cells = rows.groupBy(*[ref(c) for c in group], ref(row).alias("_a"), ref(column).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    spread = cells.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    schema = cells.select(*[ref(c) for c in group]).schema.add("n", "long").add("exceed", "long").add("replicates", "long")
    share = [replicates // chunks + (1 if i < replicates % chunks else 0) for i in range(chunks)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = int(frame["_chunk"].iloc[0])
        a, b = frame["_a"].fillna("\0"), frame["_b"].fillna("\0")
        table = pd.crosstab(a, b, values=frame["_n"], aggfunc="sum").fillna(0).to_numpy().astype(np.int64)
        n = int(table.sum())
        rng = np.random.default_rng([seed, chunk, n])
        drawn = tails.draw_tables(rng, table.sum(axis=1), table.sum(axis=0), share[chunk])
        # tables share their margins, so only the factorials of the cells matter
        seen = -tails.log_factorial(table).sum()
        weights = -tails.log_factorial(drawn).sum(axis=(1, 2))
        slack = max(1e-7, 64 * np.finfo(float).eps * abs(seen))
        hits = int((weights <= seen + slack).sum())
        out = pd.DataFrame({"n": [n], "exceed": [hits], "replicates": [share[chunk]]})
        for position, c in enumerate(group):
            out.insert(position, c, [frame[c].iloc[0]])
        return out

    parts = spread.groupBy(*[ref(c) for c in group], "_chunk").applyInPandas(run, schema)
    out = parts.groupBy(*[ref(c) for c in group]).agg(
        F.max("n").alias("n"), F.sum("exceed").alias("exceed"), F.sum("replicates").alias("replicates")
    )
    return out.withColumn("p", (ref("exceed") + 1) / (ref("replicates") + 1)).drop("_one")
