"""Site x taxon analysis: profiles, distances, group tests, indicator taxa, ordination.

A 0/1 community over k taxa has at most 2^k different profiles however many sites there are. The
distance tests below work on profiles with their site counts, which gives the same sums as all
pairs of sites without ever forming them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import tails
from riskloom.functions.columns import across, ref
from riskloom.functions.numeric import presence, strict_mean
from riskloom.operators.small import groups_of
from riskloom.sources.tables import settled



def site_means(df: DataFrame, site: Sequence[str], taxa: Sequence[str], log: bool = True) -> DataFrame:
    """Mean cover per site and taxon, log(x + 1) when asked."""
    means = df.groupBy(*[ref(c) for c in site]).agg(*[strict_mean(ref(c)).alias(c) for c in taxa])
    return across(means, taxa, F.log1p) if log else means


def presence_table(sites: DataFrame, taxa: Sequence[str]) -> DataFrame:
    return across(sites, taxa, presence)


def taxa_share(df: DataFrame, bar: Sequence[str], taxa: Sequence[str]) -> DataFrame:
    """Rows (bar, name, value, share): mean cover per taxon and its part of the bar."""
    means = df.groupBy(*[ref(c) for c in bar]).agg(*[F.avg(ref(c)).alias(c) for c in taxa])
    total = reduce(add, [ref(c) for c in taxa])
    long = means.withColumn("_all", total).unpivot([*bar, "_all"], list(taxa), "name", "value")
    return long.withColumn("share", ref("value") / F.nullif(ref("_all"), F.lit(0.0))).drop("_all")


def profiles(sites: DataFrame, taxa: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Different profiles with the number of sites that have them; sites with a null are left out."""
    return sites.na.drop(subset=list(taxa)).groupBy(*[ref(c) for c in [*by, *taxa]]).agg(F.count(F.lit(1)).alias("n_sites"))


def _distance(a: Column, b: Column, metric: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclid":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    apart = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x + y), F.lit(0.0), lambda s, v: s + v)
    bray = apart / F.nullif(both, F.lit(0.0))
    return bray if metric == "bray" else 2 * bray / (1 + bray)


def profile_label(taxa: Sequence[str]) -> Column:
    """Text key of a profile."""
    return F.concat_ws("|", *[ref(c).cast("double").cast("string") for c in taxa])


def profile_distances(
    table: DataFrame, taxa: Sequence[str], metric: str, key: Column | None = None, blocks: int = 16
) -> DataFrame:
    """Distances (profile1, profile2, n1, n2, d) between different profiles, each pair once.

    ``metric`` is ``bray``, ``jaccard`` or ``euclid``; ``table`` comes from :func:`profiles`. Two
    sites of one profile are at distance 0, any other two at that of their profiles, so this is the
    whole distance matrix: quadratic in profiles, not in sites. Pairs are matched by block pair, which spreads them evenly over tasks. The distance of two
    empty profiles is undefined and cannot occur, as they are the same profile.
    """
    key = profile_label(taxa) if key is None else key
    vector = F.array(*[ref(c).cast("double") for c in taxa])
    items = settled(table.select(key.alias("p"), "n_sites", vector.alias("v")))
    block = F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int")
    placed = items.withColumn("b", block)
    # Block pair (low, high): the left side serves as low or as high, whichever its partner is not.
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    pair_key = F.transform(every, lambda o: F.least(ref("b"), o) * blocks + F.greatest(ref("b"), o))
    left = placed.select(F.col("p").alias("profile1"), F.col("n_sites").alias("n1"), F.col("v").alias("v1"), F.col("b").alias("b1"), F.explode(pair_key).alias("cell"))
    right = placed.select(F.col("p").alias("profile2"), F.col("n_sites").alias("n2"), F.col("v").alias("v2"), F.col("b").alias("b2"), F.explode(pair_key).alias("cell"))
    low, high = F.least("b1", "b2"), F.greatest("b1", "b2")
    once = (ref("profile1") < ref("profile2")) & (ref("cell") == low * blocks + high)
    pairs = left.join(right, "cell").where(once)
    return pairs.select("profile1", "profile2", "n1", "n2", _distance(ref("v1"), ref("v2"), metric).alias("d"))


def permanova(
    sites: DataFrame, taxa: Sequence[str], group: str, metric: str = "bray"
) -> DataFrame:
    """One-factor distance-based analysis of variance: df, sums of squares, R2 and F.

    SS is the sum of squared distances over pairs divided by the number of sites, over all pairs and
    within groups; pairs are counted by profile. Sites with a null in a taxon or without a group are left out.
    """
    known = sites.na.drop(subset=[*taxa, group]).withColumn("_p", profile_label(taxa))
    counts = settled(known.groupBy(ref("_p").alias("p"), ref(group).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    dist = profile_distances(profiles(known, taxa), taxa, metric)
    square = ref("d") * ref("d")
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    whole = dist.agg(F.coalesce(F.sum(square * ref("n1") * ref("n2")), F.lit(0.0)).alias("s"))
    mine = dist.join(counts.select(F.col("p").alias("profile1"), "g", F.col("c").alias("c1")), "profile1").join(
        counts.select(F.col("p").alias("profile2"), "g", F.col("c").alias("c2")), ["profile2", "g"]
    )
    inside = mine.groupBy("g").agg(F.sum(square * ref("c1") * ref("c2")).alias("s"))
    within = sizes.join(inside, "g", "left").agg(
        F.sum(F.coalesce(ref("s"), F.lit(0.0)) / ref("n")).alias("ss_within"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    )
    out = within.select(
        (ref("groups") - 1).alias("df_between"),
        (ref("n") - ref("groups")).alias("df_within"),
        (whole.scalar() / ref("n")).alias("ss_total"),
        "ss_within",
    ).withColumn("ss_between", ref("ss_total") - ref("ss_within"))
    return out.select(
        "df_between", "df_within", "ss_between", "ss_within", "ss_total",
        (ref("ss_between") / F.nullif(ref("ss_total"), F.lit(0.0))).alias("r2"),
        (ref("ss_between") / F.nullif(ref("df_between"), F.lit(0)) / F.nullif(ref("ss_within") / F.nullif(ref("df_within"), F.lit(0)), F.lit(0.0))).alias("f"),
    )


def _squared_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances of rows of ``a`` to rows of ``b``, taxon by taxon; two empty profiles are at 0."""
    apart, both, square = (np.zeros((len(a), len(b))) for _ in range(3))
    for t in range(a.shape[1]):
        gap = np.abs(a[:, t, None] - b[None, :, t])
        apart += gap
        square += gap * gap
        both += a[:, t, None] + b[None, :, t]
    if metric == "euclid":
        return square
    bray = np.divide(apart, both, out=np.zeros_like(apart), where=both != 0)
    return (bray if metric == "bray" else 2 * bray / (1 + bray)) ** 2


def _draw_block(rng: np.random.Generator, weight: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Random tables profile x cell of one block, one for each row of ``left``, the counts of the cells in the block.

    A profile of many sites takes its counts in one draw; the sites of the others take what is left in random order.
    """
    times, cells = left.shape
    out = np.zeros((times, len(weight), cells))
    for i in np.flatnonzero(weight > 8):
        took = tails.split_counts(rng, left, int(weight[i]))
        out[:, i] = took
        left = left - took
    light = np.flatnonzero(weight <= 8)
    owner = np.repeat(light, weight[light].astype(int))
    if len(owner):
        for t in range(times):
            np.add.at(out[t], (owner, rng.permutation(np.repeat(np.arange(cells), left[t]))), 1)
    return out


def _terms_ss(inner: np.ndarray, size: np.ndarray, terms: Sequence[np.ndarray]) -> list[tuple[int, float]]:
    """Sequential (df, sum of squares) of factors from cell sums of inner products and cell sizes.

    ``terms`` holds a cell x level 0/1 matrix per factor.
    """
    basis = np.sqrt(size)[:, None] / np.sqrt(size.sum())
    root = np.where(size > 0, 1 / np.sqrt(np.maximum(size, 1)), 0.0)
    scaled = inner * root[:, None] * root[None, :]
    found = []
    for block in terms:
        design = block * np.sqrt(size)[:, None]
        design = design - basis @ (basis.T @ design)
        u, s, _ = np.linalg.svd(design, full_matrices=False)
        fresh = u[:, s > 1e-9 * max(1.0, np.sqrt(size.sum()))]
        found.append((fresh.shape[1], float(np.trace(fresh.T @ scaled @ fresh))))
        basis = np.column_stack([basis, fresh])
    return found


def permanova_terms(
    sites: DataFrame,
    taxa: Sequence[str],
    factors: Sequence[str],
    metric: str = "bray",
    permutations: int = 999,
    seed: int = 1,
    block_profiles: int = 512,
    at_once: int = 64,
) -> DataFrame:
    """Sequential terms with permutation p: (ord, term, df, sumsq, r2, f, p) plus Residuals, Total.

    Permuting labels over sites is drawing a profile x cell count table with the observed margins, and every sum of squares follows from
    the products of such tables with the squared distances. Profiles lie in blocks of about ``block_profiles``; Spark pairs the blocks, a task makes the
    distances of a pair and adds up the products of the observed and of all redrawn tables, ``at_once`` at a time, and the sums of all tasks are added by Spark.
    A block draws its part of a table from how many sites of each cell fall into it (split over the blocks beforehand) and a seed of its own, so every pair and
    every retry sees the same. On the driver are the cells (combinations of factor levels) and the sizes of blocks, no profile and no distance. The work is
    quadratic in different profiles, as the test is.
    """
    spark = sites.sparkSession
    known = sites.na.drop(subset=[*taxa, *factors])
    cells = [tuple(r) for r in known.groupBy(*[ref(c) for c in factors]).agg(F.count(F.lit(1)).alias("_n")).orderBy(*[ref(c) for c in factors]).collect()]
    levels = [sorted({c[k] for c in cells}) for k in range(len(factors))]
    terms = [np.array([[float(c[k] == v) for v in levels[k]] for c in cells]).reshape(len(cells), -1) for k in range(len(factors))]
    size = np.array([c[-1] for c in cells], np.int64)
    number, m = int(size.sum()), len(cells)

    def here(cell: tuple) -> Column:
        return reduce(lambda x, y: x & y, [ref(f) == F.lit(v) for f, v in zip(factors, cell)])

    vector = F.array(*[ref(c).cast("double") for c in taxa])
    counted = F.array(*[F.sum(here(c).cast("long")) for c in cells])
    items = settled(known.groupBy(*[ref(c) for c in taxa]).agg(counted.alias("_cells")).select(vector.alias("v"), F.col("_cells").alias("c"))) if m else None
    many = items.count() if m else 0
    blocks = max(1, -(-many // block_profiles))
    if many:
        packed = items.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("i"))
        packed = settled(packed.select("b", F.transform("i", lambda i: i["v"]).alias("v"), F.transform("i", lambda i: i["c"]).alias("c")))
        weights = {r["b"]: r["w"] for r in packed.select("b", F.aggregate(F.flatten("c"), F.lit(0).cast("long"), lambda s, v: s + v).alias("w")).collect()}
        rng, left, share = np.random.default_rng([seed, 0]), np.tile(size, (permutations, 1)), {}
        for b in sorted(weights):
            share[b] = tails.split_counts(rng, left, weights[b])
            left = left - share[b]
        held = spark.sparkContext.broadcast(share)  # permutations x blocks x cells counts
        pairs = packed.select("b", "v", "c", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("o"))
        other = packed.select(F.col("b").alias("o"), F.col("v").alias("v2"), F.col("c").alias("c2"))
        pairs = pairs.join(other, "o").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "b", "o").select("b", "o", "v", "c", "v2", "c2")
    wide = m + 1

    def tables(block: int, counts: np.ndarray, chunk: int) -> np.ndarray:
        """Redrawn tables of a chunk of permutations, and the profile's sites as one more cell."""
        weight = counts.sum(axis=1)
        part = held.value[block][chunk * at_once : (chunk + 1) * at_once]
        drawn = _draw_block(np.random.default_rng([seed, 1, block, chunk]), weight, part)
        return np.concatenate((drawn, np.broadcast_to(weight[None, :, None], (len(drawn), len(weight), 1))), axis=2)

    def sums(batches):
        total = np.zeros((permutations + 1, wide, wide))
        for batch in batches:
            for b, o, v, c, v2, c2 in zip(*(batch.column(k).to_pylist() for k in range(6))):
                mine, yours, counts, counts2 = np.array(v, float), np.array(v2, float), np.array(c, np.int64), np.array(c2, np.int64)
                d2 = _squared_distances(mine, yours, metric)
                seen = [np.column_stack((t, t.sum(axis=1)))[None].astype(float) for t in (counts, counts2)]
                for k in range(-1, -(-permutations // at_once)):  # the observed table, then the redrawn ones
                    first, left_, right_ = (0, *seen) if k < 0 else (1 + k * at_once, mine_ := tables(b, counts, k), mine_ if b == o else tables(o, counts2, k))
                    times = len(right_)
                    lifted = (d2 @ right_.transpose(1, 0, 2).reshape(len(yours), -1)).reshape(len(mine), times, wide).transpose(1, 0, 2)
                    part = left_.transpose(0, 2, 1) @ lifted
                    total[first : first + times] += part if b == o else part + part.transpose(0, 2, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations + 1)), pa.array(total.reshape(permutations + 1, -1).tolist())], names=["permutation", "q"])

    def ratios(batches):
        rows = []
        for batch in batches:
            for p, q in zip(*(batch.column(k).to_pylist() for k in range(2))):
                q = np.array(q).reshape(wide, wide)
                inner, lifted, spread = q[:m, :m], q[:m, m] / number, q[m, m] / number**2
                centred = -0.5 * (inner - lifted[:, None] * size[None, :] - size[:, None] * lifted[None, :] + spread * size[:, None] * size[None, :])
                found, total = _terms_ss(centred, size.astype(float), terms), 0.5 * spread * number
                rest_df, rest = number - 1 - sum(d for d, _ in found), total - sum(x for _, x in found)
                for k, (d, x) in enumerate(found):
                    f = (x / d) / (rest / rest_df) if d and rest > 0 and rest_df > 0 else None
                    rows.append((p, k, factors[k], d, x, f, total))
                rows.append((p, len(found), "Residuals", rest_df, rest, None, total))
                rows.append((p, len(found) + 1, "Total", number - 1, total, None, total))
        if rows:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["permutation", "ord", "term", "df", "sumsq", "f", "total"])

    ddl = "permutation long, ord long, term string, df long, sumsq double, f double, total double"
    if not many:
        return spark.createDataFrame([], "ord long, term string, df long, sumsq double, r2 double, f double, p double")
    parts = pairs.mapInArrow(sums, "permutation long, q array<double>")
    added = parts.groupBy("permutation").agg(F.array(*[F.sum(ref("q")[i]) for i in range(wide * wide)]).alias("q"))
    every = settled(added.mapInArrow(ratios, ddl))
    seen, redrawn = every.where("permutation = 0").drop("permutation"), every.where("permutation > 0").select("ord", F.col("f").alias("_f"))
    hits = seen.join(redrawn, "ord").groupBy("ord").agg(F.sum((ref("_f") >= ref("f") - 1e-9 * F.abs("f")).cast("long")).alias("hits"))
    out = seen.join(hits, "ord", "left").withColumn("r2", ref("sumsq") / F.nullif(ref("total"), F.lit(0.0)))
    p = F.when(ref("f").isNotNull(), (F.coalesce(ref("hits"), F.lit(0)) + 1) / F.lit(permutations + 1.0))
    return out.select("ord", "term", "df", "sumsq", "r2", "f", p.alias("p"))


def centroid_distances(sites: DataFrame, taxa: Sequence[str], group: str) -> DataFrame:
    """Each site with ``dist``, its Euclidean distance to its group's centroid.

    Taken from coordinates, which equals the pairwise form; no pairs are needed.
    """
    rows = sites.na.drop(subset=[*taxa, group])
    centres = rows.groupBy(ref(group)).agg(*[F.avg(ref(c)).alias(f"_m_{c}") for c in taxa])
    joined = rows.join(settled(centres), group)
    square = reduce(add, [F.pow(ref(c) - ref(f"_m_{c}"), F.lit(2.0)) for c in taxa])
    return joined.withColumn("dist", F.sqrt(square)).drop(*[f"_m_{c}" for c in taxa])


def spatial_medians(
    sites: DataFrame, taxa: Sequence[str], group: str, most_rounds: int = 80, tolerance: float = 1e-8, stride: float = 1.7
) -> DataFrame:
    """The point of each group with the smallest sum of Euclidean distances to its sites: (group, taxa...).

    Weiszfeld's iteration over distinct profiles with their counts; a round is one grouped aggregate. Where the point lies on a profile the pull
    of the other sites is held against that profile's count, which says whether it stays. Steps are lengthened by ``stride``, which below 2 still lowers the sum, and
    end when no group's sum falls by more than the share ``tolerance``. At the end the profile nearest to the point
    is tried in its place. Centres are one row of numbers for each group and go to the next round as a small table.
    """
    spark = sites.sparkSession
    held = settled(profiles(sites.na.drop(subset=[group]), taxa, [group]))
    names = [f"_m{i}" for i in range(len(taxa))]
    total = ref("n_sites").cast("double")
    start = held.groupBy(ref(group)).agg(*[(F.sum(ref(c) * total) / F.sum(total)).alias(n) for c, n in zip(taxa, names)])
    schema = start.schema
    centres = [tuple(r) for r in start.collect()]
    size = max((abs(v) for r in centres for v in r[1:]), default=0.0)

    def apart(rows: DataFrame) -> DataFrame:
        square = reduce(add, [F.pow(ref(c) - ref(n), F.lit(2.0)) for c, n in zip(taxa, names)])
        return rows.withColumn("_d", F.sqrt(square))

    seen: dict = {}
    for _ in range(most_rounds):
        near = apart(held.join(spark.createDataFrame(centres, schema), group))
        on = ref("_d") <= 1e-14 * (1 + size)
        pull = F.when(~on, total / ref("_d"))
        sums = [F.sum(F.when(on, total)).alias("_eta"), F.sum(pull).alias("_w"), F.sum(total * ref("_d")).alias("_f")]
        sums += [F.sum(pull * ref(c)).alias(f"_t{i}") for i, c in enumerate(taxa)] + [F.first(ref(n)).alias(n) for n in names]
        moved, falls = [], False
        for r in near.groupBy(ref(group)).agg(*sums).collect():
            here = np.array([r[n] for n in names])
            if r["_w"] is None:  # all sites in one point
                moved.append((r[group], *here.tolist()))
                continue
            goal = np.array([r[f"_t{i}"] for i in range(len(taxa))]) / r["_w"]
            force = r["_w"] * float(np.linalg.norm(goal - here))
            stay = min(1.0, (r["_eta"] or 0.0) / force) if force > 0 else 1.0
            there = here + (1 - stay) * (goal - here) * (1.0 if r["_eta"] else stride)
            falls = falls or seen.get(r[group], np.inf) - r["_f"] > tolerance * r["_f"]
            seen[r[group]] = r["_f"]
            moved.append((r[group], *there.tolist()))
        centres = moved
        if not falls:
            break
    point = spark.createDataFrame(centres, schema)
    near = apart(held.join(point, group))
    nearest = near.groupBy(ref(group)).agg(F.min_by(F.struct(*[ref(c) for c in taxa]), ref("_d")).alias("_p"), F.sum(total * ref("_d")).alias("_sum"))
    other = nearest.select(ref(group), "_sum", *[ref("_p")[c].alias(n) for c, n in zip(taxa, names)])
    tried = apart(held.join(settled(other), group)).groupBy(ref(group)).agg(F.sum(total * ref("_d")).alias("_new"), F.first("_sum").alias("_old"), *[F.first(n).alias(n) for n in names])
    better = tried.where(ref("_new") < ref("_old")).select(ref(group), *names)
    out = better.union(point.join(better.select(ref(group)), group, "left_anti").select(ref(group), *names))
    return settled(out.select(ref(group), *[ref(n).alias(c) for c, n in zip(taxa, names)]))


def median_distances(sites: DataFrame, taxa: Sequence[str], group: str) -> DataFrame:
    """Each site with ``dist``, its Euclidean distance to its group's spatial median; sites with a null are left out."""
    rows = sites.na.drop(subset=[*taxa, group])
    centres = spatial_medians(rows, taxa, group).select(ref(group), *[ref(c).alias(f"_m_{c}") for c in taxa])
    square = reduce(add, [F.pow(ref(c) - ref(f"_m_{c}"), F.lit(2.0)) for c in taxa])
    return rows.join(centres, group).withColumn("dist", F.sqrt(square)).drop(*[f"_m_{c}" for c in taxa])


def indicator_values(sites: DataFrame, taxa: Sequence[str], group: str) -> DataFrame:
    """Rows (taxon, grp, a, b, stat): specificity, fidelity and their geometric mean."""
    return _indval(_group_sums(sites.na.drop(subset=[*taxa, group]), taxa, group), taxa, [], 1)


def indicator_combinations(sites: DataFrame, taxa: Sequence[str], group: str, most: int | None = None) -> DataFrame:
    """As :func:`indicator_values` for every combination of up to ``most`` groups (all but the whole by default), named ``a+b``.

    Specificity is the share of the combination's groups in the sum of group means, fidelity the share of
    its sites where the taxon occurs.
    """
    return _indval(_group_sums(sites.na.drop(subset=[*taxa, group]), taxa, group), taxa, [], most)


def _group_sums(rows: DataFrame, taxa: Sequence[str], group: str) -> DataFrame:
    """(grp, n, sums, hits): sites of a group, and for each taxon its sum and the sites where it occurs."""
    arrays = [F.array(*[F.sum(ref(c).cast("double")) for c in taxa]), F.array(*[F.sum((ref(c) > 0).cast("double")) for c in taxa])]
    return rows.groupBy(ref(group).alias("grp")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[a.alias(n) for a, n in zip(arrays, ("sums", "hits"))])


def _subsets(groups: Column, most: int | None) -> Column:
    """All combinations of the elements of a sorted array, of 1 to ``most`` elements, by default all but the whole; a single group is one."""
    k = F.size(groups)
    limit = F.greatest(k - 1, F.lit(1)) if most is None else F.least(k, F.lit(most))
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), k).cast("long") - 1)
    chosen = F.transform(masks, lambda m: F.filter(groups, lambda g, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))
    return F.filter(chosen, lambda c: F.size(c) <= limit)


def _indval(sums: DataFrame, taxa: Sequence[str], by: Sequence[str], most: int | None) -> DataFrame:
    """Indicator values from sums of groups; with ``most`` 1 of single groups, else of combinations."""
    keys = [ref(c) for c in by]
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("grp", "n", "sums", "hits"))).alias("_g"))  # one cell for each group level
    single = F.transform("_g", lambda g: F.array(g))
    sets = packed.withColumn("_s", F.explode(single if most == 1 else _subsets(ref("_g"), most)))

    def mean(groups: Column, i: int) -> Column:
        return F.aggregate(groups, F.lit(0.0), lambda t, g: t + g["sums"][i] / g["n"])

    def found(i: int) -> Column:
        return F.aggregate(ref("_s"), F.lit(0.0), lambda t, g: t + g["hits"][i])

    items = []
    for i, c in enumerate(taxa):
        share = F.coalesce(mean(ref("_s"), i) / F.nullif(mean(ref("_g"), i), F.lit(0.0)), F.lit(0.0))
        hits = found(i)
        count = F.aggregate(ref("_s"), F.lit(0.0), lambda t, g: t + g["n"])
        items.append(F.struct(F.lit(c).alias("taxon"), share.alias("a"), (hits / count).alias("b")))
    name = ref("_s")[0]["grp"] if most == 1 else F.array_join(F.transform("_s", lambda g: g["grp"].cast("string")), "+")
    out = sets.select(*keys, name.alias("grp"), F.explode(F.array(*items)).alias("_i")).select(*keys, "_i.taxon", "grp", "_i.a", "_i.b")
    return out.withColumn("stat", F.sqrt(ref("a") * ref("b")))


def permuted_sums(
    rows: DataFrame, taxa: Sequence[str], key: Sequence[str], group: str, permutations: int, seed: int = 1, blocks: int | None = None
) -> DataFrame:
    """(permutation, grp, n, sums, hits) as :func:`_group_sums` has them, for labels shuffled over all sites with group sizes kept.

    A shuffle of labels is two draws: how many of each group fall into each block of sites (multivariate hypergeometric, drawn for a few
    hundred blocks from their sizes), and which sites of a block take them. A task draws the second for all
    permutations and adds up its sites, some thousand at a time, so no site is copied and no permutation sorted. Blocks follow from the
    key and draws from block and seed: a task that runs again repeats them.
    """
    spark = rows.sparkSession
    blocks = blocks or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.xxhash64(*[ref(c) for c in key])
    placed = rows.select(F.pmod(order, F.lit(blocks)).cast("int").alias("_block"), order.alias("_order"), F.array(*[ref(c).cast("double") for c in taxa]).alias("_x"), ref(group).alias("_grp"))
    sizes = [(r[0], r[1]) for r in placed.groupBy("_grp").agg(F.count(F.lit(1))).orderBy("_grp").collect()]
    levels = [g for g, _ in sizes]
    counts = {r[0]: r[1] for r in placed.groupBy("_block").agg(F.count(F.lit(1))).collect()}  # at most ``blocks`` rows
    rng, left, share = np.random.default_rng([seed, 1]), np.tile(np.array([n for _, n in sizes], np.int64), (permutations, 1)), {}
    for b in sorted(counts):
        share[b] = tails.split_counts(rng, left, counts[b])
        left = left - share[b]
    held = spark.sparkContext.broadcast(share)  # permutations x blocks x groups counts
    t, g = len(taxa), len(levels)

    def run(batches):
        last, remaining, drawn, total, n = None, None, None, None, 0

        def emit():
            perm, grp = np.divmod(np.arange(permutations * g), g)
            flat = total.reshape(permutations * g, 1 + 2 * t)
            return pa.RecordBatch.from_arrays([pa.array(perm + 1, pa.int32()), pa.array(grp, pa.int32()), pa.array(flat.tolist())], names=["permutation", "level", "v"])

        for (block,), part in groups_of(batches, ["_block"], 2048):
            x = part.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, t)
            if block != last:
                if last is not None:
                    yield emit()
                last, remaining, drawn = block, held.value[block].copy(), np.random.default_rng([seed, 2, block])
                total = np.zeros((permutations, g, 1 + 2 * t))
            values = np.column_stack((np.ones(len(x)), x, x > 0))
            here = tails.split_counts(drawn, remaining, len(x))
            remaining = remaining - here
            for p in range(permutations):
                label = drawn.permutation(np.repeat(np.arange(g), here[p]))
                for k in range(g):
                    total[p, k] += values[label == k].sum(axis=0)
        if last is not None:
            yield emit()

    parts = placed.repartition(blocks, "_block").sortWithinPartitions("_block", "_order").select("_block", "_x").mapInArrow(run, "permutation int, level int, v array<double>")
    added = parts.groupBy("permutation", "level").agg(*[F.sum(ref("v")[i]).alias(f"_{i}") for i in range(1 + 2 * t)])
    names = spark.createDataFrame(list(enumerate(levels)), T.StructType([T.StructField("level", T.IntegerType()), T.StructField("grp", rows.schema[group].dataType)]))
    return added.join(names, "level").select(
        "permutation", "grp", ref("_0").alias("n"), F.array(*[ref(f"_{1 + i}") for i in range(t)]).alias("sums"), F.array(*[ref(f"_{1 + t + i}") for i in range(t)]).alias("hits")
    )


def indicator_test(
    sites: DataFrame, taxa: Sequence[str], key: Sequence[str], group: str, permutations: int = 999, seed: int = 1, most: int | None = 1
) -> DataFrame:
    """Best group per taxon with its statistic and permutation p; with ``most`` (null: all but the whole) the best combination of so many groups."""
    rows = sites.na.drop(subset=[*taxa, group])
    seen = _indval(_group_sums(rows, taxa, group), taxa, [], most)
    best = seen.groupBy("taxon").agg(
        F.max(F.struct("stat", "grp", "a", "b")).alias("_b")
    ).select("taxon", "_b.grp", "_b.a", "_b.b", "_b.stat")
    drawn = settled(permuted_sums(rows, taxa, key, group, permutations, seed))
    null = _indval(drawn, taxa, ["permutation"], most).groupBy("permutation", "taxon").agg(F.max("stat").alias("_s"))
    joined = null.join(settled(best.select("taxon", "stat")), "taxon")
    hits = joined.groupBy("taxon").agg(F.sum((ref("_s") >= ref("stat") - 1e-12).cast("long")).alias("_h"))
    return best.join(hits, "taxon").withColumn("p", (ref("_h") + 1) / F.lit(permutations + 1.0)).drop("_h")


def ordination(sites: DataFrame, taxa: Sequence[str], keep: Sequence[str], axes: int = 2) -> DataFrame:
    """Principal axes of the site table: a metric view of which sites lie close together."""
    rows = sites.na.drop(subset=list(taxa))
    packed = VectorAssembler(inputCols=list(taxa), outputCol="_x").transform(rows)
    model = PCA(k=axes, inputCol="_x", outputCol="_pc").fit(packed)
    scores = model.transform(packed).withColumn("_a", vector_to_array("_pc"))
    return scores.select(*[ref(c) for c in keep], *[ref("_a")[i].alias(f"axis{i + 1}") for i in range(axes)])
