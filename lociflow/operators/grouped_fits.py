"""Logistic fits of thousands of groups at once: penalised, with coefficients held at zero, with bootstrap draws.

Groups of one slice are fitted where their rows are, many together, so that these are shuffled once. For larger ones the state of all
fits is a table with a row for each group, design and draw. A Newton step deals the rows of the groups that are
still open to slices, where a fit's sums are matrix products, adds these per fit, and solves each fit's small system in the task
that has its row: no loop over groups, nothing of a group's size in one task, nothing but counts on the driver.

Firth's penalty adds half the log determinant of the information. Its score needs the leverage of each row under the current
information; as the leverage is a quadratic form in the row, sums of three-fold products give it in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.operators import ordinals, rankstats
from lociflow.operators.contribution import chi_square_tail
from lociflow.sources.scratch import Scratch, bounded, join_same

#: Rows of a slice, and numbers of rows times fits that a task holds at a time.
SLICE, HELD = 20_000, 1 << 20
#: Largest absolute linear predictor.
CLIP = 30.0
#: Newton steps at most, and the largest step of a fit that is done.
STEPS, TOLERANCE = 200, 1e-8
#: Name -> (features of the design, those of them held at zero)
Designs = Mapping[str, tuple[Sequence[str], Sequence[str]]]

# Distribution function of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def draw_weights(block: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Weights of each block (a hash) in each draw: Poisson(1) by a hash of both; draw 0 weighs all rows 1."""
    x = block.astype(np.int64).view(np.uint64)[:, None] ^ (draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.where(draws[None, :] == 0, 1.0, np.searchsorted(_POISSON, u, side="right"))


def products(d: int) -> tuple[list, list]:
    """Pairs and triples of columns whose products are summed."""
    return list(combinations_with_replacement(range(d), 2)), list(combinations_with_replacement(range(d), 3))


def fit_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Per fit: rows, positives, log likelihood, gradient, information and the three-fold products, weighted."""
    pairs, triples = products(x.shape[1])
    z = np.clip(x @ beta.T, -CLIP, CLIP)
    p = 1 / (1 + np.exp(-z))
    v = w * p * (1 - p)
    two = np.stack([x[:, a] * x[:, b] for a, b in pairs], axis=1)
    three = np.stack([x[:, a] * x[:, b] * x[:, c] for a, b, c in triples], axis=1)
    loglik = (w * (y[:, None] * z - np.logaddexp(0, z))).sum(axis=0)
    return np.concatenate([[w.sum(axis=0), y @ w, loglik], x.T @ (w * (y[:, None] - p)), two.T @ v, three.T @ (v * (0.5 - p))]).T


def unpacked(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, information and three-fold products of each fit as full arrays."""
    pairs, triples = products(d)
    info, cube = np.zeros((len(sums), d, d)), np.zeros((len(sums), d, d, d))
    for i, (a, b) in enumerate(pairs):
        info[:, a, b] = info[:, b, a] = sums[:, 3 + d + i]
    for i, t in enumerate(triples):
        for a, b, c in {(t[i], t[j], t[k]) for i in range(3) for j in range(3) for k in range(3) if {i, j, k} == {0, 1, 2}}:
            cube[:, a, b, c] = sums[:, 3 + d + len(pairs) + i]
    return sums[:, 3 : 3 + d], info, cube


def newton(sums: np.ndarray, beta: np.ndarray, design: np.ndarray, designs: list[tuple[list[int], list[int]]], d: int, firth: bool, l2: float, tolerance: float, last: bool) -> tuple[np.ndarray, ...]:
    """Coefficients after a step from these sums, which fits are done, errors, penalised likelihoods, and which fits have both
    classes. ``last``: no step, but errors and likelihoods; fits of one class, which have none, get NaN."""
    gradient, info, cube = unpacked(sums, d)
    mixed = (sums[:, 1] > 0) & (sums[:, 1] < sums[:, 0])
    done, se, penalised = ~mixed, np.full((len(sums), d), np.nan), np.full(len(sums), np.nan)
    for i, (used, free) in enumerate(designs):
        at = np.flatnonzero((design == i) & mixed)
        ridge = l2 * np.diag([float(c > 0) for c in range(d)])
        own = (info + ridge)[np.ix_(at, used, used)]
        inverse = np.linalg.pinv(own, hermitian=True)
        if last:
            se[np.ix_(at, used)] = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0))
            sign, size = np.linalg.slogdet(own)
            penalised[at] = sums[at, 2] + 0.5 * np.where(sign > 0, size, -np.inf)
            continue
        score = gradient[np.ix_(at, free)] - l2 * beta[np.ix_(at, free)] * (np.array(free) > 0)
        if firth:
            score = score + np.einsum("njab,nab->nj", cube[np.ix_(at, free, used, used)], inverse)
        step = np.einsum("nij,nj->ni", np.linalg.pinv((info + ridge)[np.ix_(at, free, free)], hermitian=True), score)
        size = np.abs(step).max(axis=1, initial=0.0)
        beta[np.ix_(at, free)] += step * np.minimum(1, 5 / np.maximum(size, 1e-12))[:, None]
        done[at] = size < tolerance
    if last:
        beta[~mixed] = np.nan
    return beta, done, se, penalised, mixed


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def group_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``fit_sums``, but of one fit for each of the groups that the rows lie in one after another."""
    pairs, triples = products(x.shape[1])
    z = np.clip((x * np.repeat(beta, sizes, axis=0)).sum(axis=1), -CLIP, CLIP)
    p = 1 / (1 + np.exp(-z))
    v, wrong = w * p * (1 - p), w * (y - p)
    third = v * (0.5 - p)
    columns = [w, w * y, w * (y * z - np.logaddexp(0, z)), *(c * wrong for c in x.T), *(x[:, a] * x[:, b] * v for a, b in pairs), *(x[:, a] * x[:, b] * x[:, c] * third for a, b, c in triples)]
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.add.reduceat(c, starts) for c in columns], axis=1)


def fits_together(x: np.ndarray, y: np.ndarray, block: np.ndarray, sizes: np.ndarray, designs: list[tuple[list[int], list[int]]], draws: int, firth: bool, l2: float, steps: int, tolerance: float) -> Iterator[tuple]:
    """Per draw and design the fits of all groups that the rows lie in one after another, their steps taken together: design, draw,
    coefficients, which are still open, steps taken, sums, errors, penalised likelihoods and which have both classes."""
    d = x.shape[1]
    for draw in range(draws + 1):
        w = draw_weights(block, np.array([draw]))[:, 0]
        for i in range(len(designs)):
            design, beta, taken = np.full(len(sizes), i), np.zeros((len(sizes), d)), np.zeros(len(sizes), np.int32)
            open_ = np.ones(len(sizes), bool)
            for _ in range(steps):
                if not open_.any():
                    break
                at = np.repeat(open_, sizes)
                sums = group_sums(x[at], y[at], w[at], beta[open_], sizes[open_])
                taken[open_] += 1
                beta[open_], done, *_rest = newton(sums, beta[open_], design[open_], designs, d, firth, l2, tolerance, False)
                open_[np.flatnonzero(open_)[done]] = False
            sums = group_sums(x, y, w, beta, sizes)
            beta, _, se, penalised, mixed = newton(sums, beta, design, designs, d, firth, l2, tolerance, True)
            yield i, draw, beta, open_, taken, sums, se, penalised, mixed


def _whole(rows: DataFrame, designs: list[tuple[list[int], list[int]]], draws: int, d: int, firth: bool, l2: float, steps: int, tolerance: float) -> DataFrame:
    """The final state of all fits of groups of one slice each: ``rows`` are shuffled once, and the steps of many groups are taken
    together where these are."""

    def fitted(gid: np.ndarray, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, sizes = np.unique(gid, return_counts=True)
        for i, draw, beta, open_, taken, sums, se, penalised, mixed in fits_together(x, y, block, sizes, designs, draws, firth, l2, steps, tolerance):
            same = lambda v, kind: pa.array(np.full(len(names), v), kind)
            out = {"gid": pa.array(names), "fit": same(i * (draws + 1) + draw, pa.int32()), "draw": same(draw, pa.int32()), "design": same(i, pa.int32()), "slices": same(1, pa.int64()), "beta": _lists(beta), "done": pa.array(~open_)}
            out |= {"steps": pa.array(taken), "se": _lists(se), "loglik": pa.array(np.where(mixed, sums[:, 2], np.nan)), "penalised": pa.array(penalised), "n": pa.array(sums[:, 0].copy()), "n_pos": pa.array(sums[:, 1].copy())}
            yield pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column("gid").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("y").to_numpy(), batch.column("block").to_numpy())
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
            ends = np.searchsorted(held[0], held[0][-1])  # the last group may go on in the next batch
            if ends >= 2 * SLICE:
                yield from fitted(*(c[:ends] for c in held))
                held = tuple(c[ends:] for c in held)
        if held is not None:
            yield from fitted(*held)

    sorted_ = rows.select("gid", "x", "y", "block").repartition("gid").sortWithinPartitions("gid")
    return sorted_.mapInArrow(run, "gid long, fit int, draw int, design int, slices long, beta array<double>, done boolean, steps int, se array<double>, loglik double, penalised double, n double, n_pos double")


def _totals(rows: DataFrame, state: DataFrame, d: int, scratch: Scratch) -> DataFrame:
    """gid, fit and s0, s1, ...: the sums of the state's fits over the rows of their groups."""
    pairs, triples = products(d)
    names = [f"s{i}" for i in range(3 + d + len(pairs) + len(triples))]
    open_ = scratch.keep(state.select("gid", "slices").distinct(), "open")
    sent = state.select("gid", "fit", "draw", "beta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    kept = rows.join(bounded(open_.select("gid"), 16), "gid", "left_semi")

    def add(own: pa.Table, fits: pa.Table) -> pa.Table:
        columns = [pa.array(np.zeros(0))] * len(names)
        if not len(own) or not len(fits):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), *columns], names=["gid", "fit", *names])
        x = own.column("x").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
        y, block = own.column("y").to_numpy(), own.column("block").to_numpy()
        beta = fits.column("beta").combine_chunks().flatten().to_numpy().reshape(len(fits), -1)
        draws, which = np.unique(fits.column("draw").to_numpy(), return_inverse=True)
        total, step = np.zeros((len(fits), len(names))), max(1, HELD // max(len(fits), len(names)))
        for at in range(0, len(x), step):
            w = draw_weights(block[at : at + step], draws)[:, which]
            total += fit_sums(x[at : at + step], y[at : at + step], w, beta)
        return pa.Table.from_arrays([fits.column("gid"), fits.column("fit"), *[pa.array(total[:, i].copy()) for i in range(len(names))]], names=["gid", "fit", *names])

    found = kept.groupBy("gid", "slice").cogroup(sent.groupBy("gid", "slice")).applyInArrow(add, "gid long, fit int, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy("gid", "fit").agg(*[F.sum(n).alias(n) for n in names])


def _solved(state: DataFrame, totals: DataFrame, designs: list[tuple[list[int], list[int]]], d: int, firth: bool, l2: float, tolerance: float, last: bool) -> DataFrame:
    """The state after a Newton step; ``last``: at the state as it is, with errors and likelihoods."""
    columns = ["gid", "fit", "draw", "design", "slices", "beta", "done", "steps"] + (["se", "loglik", "penalised", "n", "n_pos"] if last else [])
    kinds = {"gid": "long", "fit": "int", "draw": "int", "design": "int", "slices": "long", "beta": "array<double>", "done": "boolean", "steps": "int", "se": "array<double>"}

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = sorted((c for c in batch.schema.names if c[0] == "s" and c[1:].isdigit()), key=lambda c: int(c[1:]))
            sums = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            beta = batch.column("beta").flatten().to_numpy().reshape(-1, d).copy()
            design, steps, done = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("design", "steps", "done"))
            beta, fresh, se, penalised, mixed = newton(sums, beta, design, designs, d, firth, l2, tolerance, last)
            if not last:
                done, steps = fresh, steps + 1
            out = {c: batch.column(c) for c in ("gid", "fit", "draw", "design", "slices")} | {"beta": _lists(beta), "done": pa.array(done), "steps": pa.array(steps, pa.int32())}
            if last:
                out |= {"se": _lists(se), "loglik": pa.array(np.where(mixed, sums[:, 2], np.nan)), "penalised": pa.array(penalised), "n": pa.array(sums[:, 0].copy()), "n_pos": pa.array(sums[:, 1].copy())}
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    return state.join(totals, ["gid", "fit"]).mapInArrow(solve, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def fit_groups(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, designs: Designs, firth: bool = True, l2: float = 0.0, draws: int = 0, block: Sequence[str] = (), steps: int = STEPS, tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """One row per group, design and draw: by..., design, draw, beta and se (intercept first, then ``features`` in order; 0 and
    null where a design has not), loglik, penalised (with half the log determinant of the design's information), n, n_pos, done.

    ``firth`` adds the penalty of the information, ``l2`` half the squared coefficients without the intercept.
    A design is its features and those of them held at zero; these stay in the information, so that likelihoods of designs with the
    same features compare. Draw 0 is the fit on all rows; ``draws`` further ones weigh each ``block`` (else each row) by Poisson
    draws from hashes. Rows with a null or NaN feature or a null label take no part; a group or draw of one class has null results;
    nulls in ``by`` are a group. Not done after ``steps``: done is false.
    """
    scratch = scratch or Scratch(df.sparkSession)
    by, d = list(by), len(features) + 1
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    clean = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features], F.col(label).isNotNull())
    own = F.lit(0).cast("long") if not draws else F.xxhash64(*block) if block else F.xxhash64(F.monotonically_increasing_id())
    rows = scratch.keep(df.where(clean).select(*by, x.alias("x"), F.col(label).cast("double").alias("y"), own.alias("block")), "rows")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("gid", F.monotonically_increasing_id()).withColumn("slices", F.ceil(F.col("_n") / SLICE))
    groups = scratch.keep(groups, "groups")
    small = F.col("slices") == 1
    dealt = lambda of: join_same(rows, bounded(groups.where(of), 64), by)
    slice_ = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("slices")).alias("slice")
    sliced = scratch.keep(dealt(~small).select("gid", slice_, "x", "y", "block"), "sliced")
    place = {c: i + 1 for i, c in enumerate(features)}
    indexed = [(sorted([0, *(place[c] for c in used)]), sorted([0, *(place[c] for c in used if c not in set(held))])) for used, held in designs.values()]
    fits = F.explode(F.array(*[F.struct(F.lit(i * (draws + 1) + j).alias("fit"), F.lit(j).alias("draw"), F.lit(i).alias("design")) for i in range(len(designs)) for j in range(draws + 1)]))
    whole = _whole(dealt(small), indexed, draws, d, firth, l2, steps, tolerance)
    state = groups.where(~small).select("gid", "slices", fits.alias("f")).select("gid", "f.fit", "f.draw", "f.design", "slices", F.array_repeat(F.lit(0.0), d).alias("beta"), F.lit(False).alias("done"), F.lit(0).alias("steps"))
    state = scratch.keep(state, "state")
    for _ in range(steps):
        active = state.where("NOT done")
        if not active.limit(1).count():
            break
        moved = _solved(active, _totals(sliced, active, d, scratch), indexed, d, firth, l2, tolerance, last=False)
        state = scratch.keep(moved.unionByName(state.where("done")), "state")
    final = scratch.keep(_solved(state, _totals(sliced, state, d, scratch), indexed, d, firth, l2, tolerance, last=True).unionByName(whole), "final")
    name = F.element_at(F.array(*map(F.lit, designs)), F.col("design") + 1)
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    none = lambda c: F.transform(c, lambda v: F.when(~F.isnan(v), v))
    found = final.join(bounded(groups.select("gid", *by), 64), "gid")
    return found.select(*by, name.alias("design"), "draw", none("beta").alias("beta"), none("se").alias("se"), nan("loglik").alias("loglik"), nan("penalised").alias("penalised"), "n", "n_pos", "done")


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal as whole batches."""

    @F.pandas_udf("double")
    def tail(z):
        import pandas as pd

        return pd.Series([None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)) for v in z.tolist()], dtype="float64")

    return tail(z)


def likelihood_ratio(df: DataFrame, by: Sequence[str], base: Sequence[str], extra: Sequence[str], label: str, scratch: Scratch | None = None) -> DataFrame:
    """Per group the profile penalised likelihood-ratio test of ``extra``: by..., ratio, df, p, and coef and se of the first
    of ``extra``. The null fit holds ``extra`` at zero in the full design, so that both sides have the same penalty."""
    features = [*base, *extra]
    fits = fit_groups(df, by, features, label, {"full": (features, []), "null": (features, list(extra))}, scratch=scratch)
    first, freedom = len(base) + 1, len(extra)
    of = lambda d, c: F.max(F.when(F.col("design") == d, c))  # noqa: E731  one row of each design
    wide = fits.groupBy(*by).agg(of("full", F.col("penalised")).alias("_f"), of("null", F.col("penalised")).alias("_n"), of("full", F.col("beta")[first]).alias("coef"), of("full", F.col("se")[first]).alias("se"), F.min("done").alias("done"))

    @F.pandas_udf("double")
    def tail(ratio):
        import pandas as pd

        return pd.Series([None if v is None or v != v or math.isinf(v) else chi_square_tail(v, freedom) for v in ratio.tolist()], dtype="float64")

    ratio = F.greatest(F.lit(0.0), 2 * (F.col("_f") - F.col("_n")))
    return wide.withColumn("ratio", F.when(F.col("_f").isNotNull() & F.col("_n").isNotNull(), ratio)).select(*by, "ratio", F.lit(freedom).alias("df"), tail("ratio").alias("p"), "coef", "se", "done")


def standardised(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns as population z-scores in each group, 0 where they do not vary."""
    stats = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    joined = join_same(df, stats, by)
    z = {c: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return joined.withColumns(z).select(*df.columns)


#: The designs of an effect: the score's size alone, and with the control beside it.
_EFFECTS = {"alone": ["_size"], "controlled": ["_size", "_control"]}
#: Rows of a task that has whole groups.
DEALT = 400_000


def _semi(rows: DataFrame, keys: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """The rows whose group is among the stored ``keys``, or is not; nulls are a group."""
    renamed = bounded(keys.toDF(*[f"_key_{c}" for c in by]), 64)
    return rows.join(renamed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]), how)


def _too_few(least: int) -> Column:
    return (F.col("n") < least) | (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))


def group_aurocs(value: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The AUROC of each of the groups that the rows lie in one after another; NaN for one class."""
    group, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    order = np.lexsort((value, group))
    v, positive = value[order], y[order] == 1
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (group[1:] != group[:-1])])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    ranks = (first + (np.diff(np.append(first, len(v))) + 1) / 2)[run] - starts[group]
    p = np.add.reduceat(positive.astype(float), starts)
    pairs = p * (sizes - p)
    return np.where(pairs > 0, np.add.reduceat(ranks * positive, starts) - p * (p + 1) / 2, np.nan) / np.where(pairs > 0, pairs, 1)


def group_scores(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the group's mean and each group's population deviation, exactly 0 where the value does not vary."""
    starts = np.cumsum(sizes) - sizes
    moved = value - np.repeat(value[starts], sizes)
    moved = moved - np.repeat(np.add.reduceat(moved, starts) / sizes, sizes)
    return moved, np.sqrt(np.add.reduceat(moved * moved, starts) / sizes)


def _effects_together(rows: DataFrame, by: list[str], scores: Sequence[str], blocks: list[str], least: int, draws: int, total: int) -> DataFrame:
    """by..., score, n, n_pos, n_dropped, corr, control_auroc, score_auroc and fits (design, draw, coef, se, other) of groups of one
    slice each. ``rows`` are shuffled once, with all scores beside one another; many groups are taken together where they are."""
    kinds = {f.name: f for f in rows.schema.fields}
    fit = T.ArrayType(T.StructType([T.StructField("design", T.StringType()), T.StructField("draw", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("coef", "se", "other")]]))
    found = [T.StructField("score", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n", "n_pos", "n_dropped")], *[T.StructField(c, T.DoubleType()) for c in ("corr", "control_auroc", "score_auroc")], T.StructField("fits", fit)]
    schema = T.StructType([*[kinds[c] for c in by], *found])
    designs = [([0, *range(1, len(used) + 1)],) * 2 for used in _EFFECTS.values()]

    def of_score(i: int, keys: list[pa.Array], own: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        column = lambda c: own.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        size, control, y = column(f"_size{i}"), column("_control"), column("_y")
        ok, starts = ~(np.isnan(size) | np.isnan(control)), np.cumsum(sizes) - sizes
        n, n_pos = np.add.reduceat(ok.astype(np.int64), starts), np.add.reduceat(np.where(ok, y, 0).astype(np.int64), starts)
        tested = (n >= max(least, 1)) & (n_pos != 0) & (n_pos != n)
        told, lists = {c: np.full(len(sizes), np.nan) for c in ("corr", "control_auroc", "score_auroc")}, np.zeros(len(sizes), np.int64)
        has_corr, flat = np.zeros(len(sizes), bool), None
        if tested.any():
            at, left = ok & np.repeat(tested, sizes), n[tested]
            size, control, y, block = size[at], control[at], y[at].astype(float), column("block")[at]
            (a, sd_a), (b, sd_b) = group_scores(size, left), group_scores(control, left)
            both = sd_a * sd_b
            has_corr[tested] = both != 0
            told["corr"][tested] = np.add.reduceat(a * b, np.cumsum(left) - left) / left / np.where(both != 0, both, 1)
            told["control_auroc"][tested], told["score_auroc"][tested] = group_aurocs(control, y, left), group_aurocs(size, y, left)
            z = [np.where(np.repeat(sd == 0, left), 0.0, m / np.repeat(np.where(sd == 0, 1, sd), left)) for m, sd in ((a, sd_a), (b, sd_b))]
            clean = ~(np.isnan(z[0]) | np.isnan(z[1]))  # an infinite value leaves none of its group
            kept = np.add.reduceat(clean.astype(np.int64), np.cumsum(left) - left)
            x = np.stack([np.ones(clean.sum()), z[0][clean], z[1][clean]], axis=1)
            lists[np.flatnonzero(tested)[kept > 0]] = len(designs) * (draws + 1)
            if len(x):
                made = [(d, draw, beta[:, 1], se[:, 1], beta[:, 2]) for d, draw, beta, _, _, _, se, _, _ in fits_together(x, y[clean], block[clean], kept[kept > 0], designs, draws, True, 0.0, STEPS, TOLERANCE)]
                of_fit = lambda k: np.stack([m[k] for m in made], axis=1).ravel()
                names, fitted = list(_EFFECTS), int((kept > 0).sum())
                number = lambda v: pa.array(v, mask=np.isnan(v))
                flat = [pa.array([names[m[0]] for m in made] * fitted, pa.string()), pa.array([m[1] for m in made] * fitted, pa.int32()), *[number(of_fit(k)) for k in (2, 3, 4)]]
        flat = flat or [pa.array([], pa.string()), pa.array([], pa.int32()), *[pa.array([], pa.float64())] * 3]
        items = pa.StructArray.from_arrays(flat, names=["design", "draw", "coef", "se", "other"])
        fits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lists)), pa.int32()), items)
        auroc = lambda c: pa.array(told[c], mask=np.isnan(told[c]))
        arrays = [*keys, pa.array([scores[i]] * len(sizes), pa.string()), pa.array(n), pa.array(n_pos), pa.array(sizes - n), pa.array(told["corr"], mask=~has_corr), auroc("control_auroc"), auroc("score_auroc"), fits]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def told(own: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(own.column("first").to_numpy())
        sizes = np.diff(np.append(starts, len(own)))
        keys = [own.column(c).take(pa.array(starts)).combine_chunks() for c in by]
        for i in range(len(scores)):
            yield of_score(i, keys, own, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= 2 * SLICE:
                own = pa.Table.from_batches(held)
                end = int(np.flatnonzero(own.column("first").to_numpy())[-1])  # the last group may go on in the next batch
                if end:
                    yield from told(own.slice(0, end))
                rest = own.slice(end).combine_chunks()
                held, rows_held = rest.to_batches(), len(rest)
        if held:
            yield from told(pa.Table.from_batches(held))

    block = F.lit(0).cast("long") if not draws else F.xxhash64(*blocks) if blocks else F.xxhash64(F.monotonically_increasing_id())
    sent = rows.select(*by, "_y", "_control", *[f"_size{i}" for i in range(len(scores))], block.alias("block"))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fits take time: also few rows are spread over tasks
    sent = sent.repartition(max(1, min(usual, math.ceil(total / (2 * SLICE))), math.ceil(total / DEALT)), *by)
    in_group = Window.partitionBy(*by).orderBy("_control")
    return sent.withColumn("first", F.row_number().over(in_group) == 1).mapInArrow(run, schema)


def _effects_apart(rows: DataFrame, by: list[str], scores: Sequence[str], blocks: list[str], least: int, draws: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same of groups of any size, none of them whole in a task, and their fits in a table of their own."""
    keys = [*by, "score"]
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(f"_size{i}").alias("_size")) for i, s in enumerate(scores)])).alias("_cell")
    long = rows.select(*by, *blocks, "_y", "_control", cells).select("*", "_cell.*").drop("_cell")
    bad = F.coalesce(F.isnan("_size") | F.isnan("_control"), F.lit(False)) | F.col("_size").isNull() | F.col("_control").isNull()
    long = scratch.keep(long.withColumn("_bad", bad), "long")
    counts = long.groupBy(*keys).agg(F.sum((~F.col("_bad")).cast("long")).alias("n"), F.sum(F.when(~F.col("_bad"), F.col("_y").cast("long")).otherwise(0)).alias("n_pos"), F.sum(F.col("_bad").cast("long")).alias("n_dropped"))
    counts = scratch.keep(counts, "counts")
    rows = join_same(long.where("NOT _bad"), counts.where(~_too_few(least)).select(*keys), keys)
    spread = F.nullif(F.stddev_pop("_size") * F.stddev_pop("_control"), F.lit(0.0))
    told = rows.groupBy(*keys).agg((F.covar_pop("_size", "_control") / spread).alias("corr"))
    for name, column in (("control_auroc", "_control"), ("score_auroc", "_size")):
        found = rankstats.auroc(rows, column, "_y", keys).select(*keys, F.col("auroc").alias(name))
        told = join_same(told, found, keys)
    z = standardised(rows, keys, ["_size", "_control"])
    fits = fit_groups(z, keys, ["_size", "_control"], "_y", {name: (used, []) for name, used in _EFFECTS.items()}, draws=draws, block=blocks, scratch=scratch)
    fits = scratch.keep(fits.select(*keys, "design", "draw", F.col("beta")[1].alias("coef"), F.col("se")[1].alias("se"), F.col("beta")[2].alias("other")), "fits")
    return join_same(counts, told, keys, "left"), fits


def effect_tests(df: DataFrame, by: Sequence[str], scores: Sequence[str], label: str, control: str, least: int = 20, draws: int = 0, block: Sequence[str] = (), alpha: float = 0.05, scratch: Scratch | None = None) -> DataFrame:
    """For each group and score: does the score's size predict the label, alone and with a control beside it?

    by..., score, n, n_pos, n_dropped, note, corr (size with control), control_auroc, score_auroc, control_coef, attenuation (share
    of the coefficient that the control explains), and for ``alone`` and ``controlled``: coef, se, p (Wald), q (step-up over all
    groups and scores), survives (q below ``alpha`` and a positive coefficient); with ``draws`` also low, high and p_boot, from the
    draws by ``block``. Coefficients are Firth's, of z-scores within the group. Rows without score or control are dropped and
    counted; groups below ``least`` rows or of one class are noted and have nulls.
    """
    scratch = scratch or Scratch(df.sparkSession)
    by = list(by)
    if not by:  # one group
        return effect_tests(df.withColumn("_all", F.lit(0)), ["_all"], scores, label, control, least, draws, block, alpha, scratch).drop("_all")
    keys, blocks = [*by, "score"], [f"_block{i}" for i in range(len(block))]
    rows = df.where(F.col(label).isNotNull()).select(*by, *[F.col(c).alias(b) for c, b in zip(block, blocks)], F.col(label).cast("int").alias("_y"), F.col(control).cast("double").alias("_control"), *[F.abs(F.col(s).cast("double")).alias(f"_size{i}") for i, s in enumerate(scores)])
    rows = scratch.keep(rows.where("_y IS NOT NULL"), "rows")
    sizes = scratch.keep(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    large = scratch.keep(sizes.where(F.col("_n") > SLICE).select(*by), "large")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    counts = scratch.keep(_effects_together(_semi(rows, large, by, "left_anti"), by, scores, blocks, least, draws, total), "together")
    fits = counts.select(*keys, F.explode("fits").alias("f")).select(*keys, "f.*")
    counts = counts.drop("fits")
    if large.limit(1).count():
        more, further = _effects_apart(_semi(rows, large, by, "left_semi"), by, scores, blocks, least, draws, scratch)
        counts, fits = counts.unionByName(more), fits.unionByName(further)
    note = F.when(_too_few(least), "insufficient data").otherwise("")
    counts = counts.select(*keys, "n", "n_pos", "n_dropped", note.alias("note"), "corr", "control_auroc", "score_auroc")
    whole = fits.where("draw = 0").withColumn("p", normal_two_sided(F.when(F.col("se") > 0, F.col("coef") / F.col("se"))))
    whole = ordinals.benjamini_hochberg(scratch.keep(whole, "whole"), "p", ["design"], scratch)
    out = counts
    for name in ("alone", "controlled"):
        own = whole.where(F.col("design") == name)
        kept = own.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("coef", "se", "p", "q")], *([F.col("other").alias("control_coef")] if name == "controlled" else []))
        out = join_same(out, kept, keys, "left").withColumn(f"{name}_survives", F.coalesce((F.col(f"{name}_q") < alpha) & (F.col(f"{name}_coef") > 0), F.lit(False)))
        if draws:
            n = F.count("coef")
            share = lambda c: F.sum(c.cast("long")) / n
            boot = fits.where((F.col("draw") > 0) & (F.col("design") == name)).groupBy(*keys).agg(
                n.alias("_ok"), F.percentile("coef", F.lit(0.025)).alias("low"), F.percentile("coef", F.lit(0.975)).alias("high"), F.greatest(2 * F.least(share(F.col("coef") <= 0), share(F.col("coef") >= 0)), 1 / n).alias("p_boot")
            )
            enough = lambda c: F.when(F.col("_ok") >= 50, F.col(c)).alias(f"{name}_{c}")
            out = join_same(out, boot.select(*keys, *map(enough, ("low", "high", "p_boot"))), keys, "left")
    return out.withColumn("attenuation", 1 - F.col("controlled_coef") / F.nullif(F.col("alone_coef"), F.lit(0.0)))
