"""Bootstraps that weigh whole blocks: draws are columns of a matrix of weights, never rows.

A weighted AUROC is a sum over tied scores of the positives there times the negatives below and half of those equal. Runs of
neighbouring scores add up: with ``u`` the sum inside a run and ``p`` and ``n`` its weights, two runs give u + u' + n p'. Rows are
dealt over range partitions of the score; a partition gives its first and last score, which others may share, and the run
between, each with a number for every draw, and these few runs are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import stats
from lociflow.operators.grouped_fits import draw_weights
from lociflow.sources.scratch import Scratch, join_same

#: Rows whose weights in all draws a task holds at a time.
HELD = 8_192


def runs(score: np.ndarray, y: np.ndarray, block: np.ndarray, draws: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """(first score, last score, [p, n, u] for each draw) of the first score, of the last one, and of those between, of sorted rows."""
    starts = np.concatenate([[0], np.flatnonzero(score[1:] != score[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(score)]])
    found, at = [], 0
    spans = [(0, 1)] + ([(1, len(starts) - 1)] if len(starts) > 2 else []) + ([(len(starts) - 1, len(starts))] if len(starts) > 1 else [])
    for a, b in spans:
        total = np.zeros((3, len(draws)))
        at = a
        while at < b:
            # whole scores of up to HELD rows together; a score of more rows is read in pieces
            stop = max(at + 1, int(np.searchsorted(ends[:b], starts[at] + HELD, side="right")))
            p, n = np.zeros((stop - at, len(draws))), np.zeros((stop - at, len(draws)))
            for lo in range(starts[at], ends[stop - 1], HELD):
                hi = min(lo + HELD, ends[stop - 1])
                w = draw_weights(block[lo:hi], draws)
                cut = np.clip(starts[at:stop], lo, hi) - lo
                full = np.flatnonzero(np.minimum(ends[at:stop], hi) > np.maximum(starts[at:stop], lo))
                for sums, part in ((p, w * y[lo:hi, None]), (n, w * (1 - y[lo:hi, None]))):
                    sums[full] += np.add.reduceat(part, cut[full], axis=0)
            below = np.cumsum(n, axis=0) - n
            total = joined(total, np.stack([p.sum(axis=0), n.sum(axis=0), (p * (below + n / 2)).sum(axis=0)]))
            at = stop
        found.append((float(score[starts[a]]), float(score[starts[b - 1]]), total))
    return found


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Two neighbouring runs as one."""
    return np.stack([one[0] + two[0], one[1] + two[1], one[2] + two[2] + one[1] * two[0]])


def weighted_aurocs(df: DataFrame, scores: Sequence[str], label: str, block: Sequence[str], by: Sequence[str] = (), draws: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """by..., score and auc, an array of the AUROC on all rows and in ``draws`` draws of Poisson weights for whole blocks.

    Null and NaN scores and null labels are left out per score; a draw of one class has a null. Nulls in ``by`` are a group.
    """
    scratch = scratch or Scratch(df.sparkSession)
    by = list(by)
    names = [f"_by{i}" for i in range(len(by))]
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("which"), F.col(s).cast("double").alias("value")) for s in scores])).alias("cell")
    rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.xxhash64(*block).alias("block"), F.col(label).cast("double").alias("y"), cells)
    rows = rows.select(*names, "cell.*", "y", "block").where(F.col("value").isNotNull() & ~F.isnan("value"))
    groups = scratch.keep(rows.groupBy(*names, "which").agg(F.count(F.lit(1)).alias("_n")).withColumn("gid", F.monotonically_increasing_id()).drop("_n"), "groups")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = join_same(rows, F.broadcast(groups), [*names, "which"]).select("gid", "value", "y", "block", F.monotonically_increasing_id().alias("_salt"))  # few groups
    dealt = dealt.repartitionByRange(parts, "gid", "value", "_salt").sortWithinPartitions("gid", "value")
    order = np.arange(draws + 1)
    schema = pa.schema([("gid", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("part", pa.int32()), ("at", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held: list[tuple[int, float, float, np.ndarray]] = []  # runs of the partition, in order

        def add(gid: int, low: float, high: float, sums: np.ndarray) -> None:
            if len(held) > 1 and held[-1][0] == held[-2][0] == gid and held[-1][1] < low:
                # what lies between the partition's first and the newest score of the group is one run
                if len(held) > 2 and held[-3][0] == gid:
                    held[-2:] = [(gid, held[-2][1], held[-1][2], joined(held[-2][3], held[-1][3]))]
            held.append((gid, low, high, sums))

        for batch in batches:
            if not batch.num_rows:
                continue
            gids, value, y, block = (batch.column(c).to_numpy() for c in ("gid", "value", "y", "block"))
            cuts = np.concatenate([[0], np.flatnonzero(gids[1:] != gids[:-1]) + 1, [len(gids)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                for low, high, sums in runs(value[a:b], y[a:b], block[a:b], order):
                    if held and held[-1][0] == gids[a] and held[-1][1] == held[-1][2] == low == high:
                        held[-1] = (gids[a], low, high, tied(held[-1][3], sums))
                    else:
                        add(int(gids[a]), low, high, sums)
        for gid, low, high, sums in held:
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([low]), pa.array([high]), pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([sums.ravel()], pa.list_(pa.float64()))], schema=schema)
            at += 1

    pieces = scratch.keep(dealt.mapInArrow(gather, "gid long, low double, high double, part int, at int, sums array<double>"), "runs")

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("part", "at", "low", "high", "sums")]))
        total, last = np.zeros((3, draws + 1)), None  # last: the newest run while it is one score
        for _, _, low, high, sums in rows:
            sums = np.array(sums).reshape(3, -1)
            if last is not None and last[0] == low == high:
                last = (low, tied(last[1], sums))
                continue
            total = joined(total, last[1]) if last is not None else total
            last = (low, sums) if low == high else None
            total = total if last is not None else joined(total, sums)
        total = joined(total, last[1]) if last is not None else total
        with np.errstate(invalid="ignore", divide="ignore"):
            auc = total[2] / (total[0] * total[1])
        return pa.table({"gid": pa.array([table.column("gid")[0].as_py()]), "auc": pa.array([[None if x != x else x for x in auc.tolist()]], pa.list_(pa.float64()))})

    # a few runs for each partition, whatever the rows
    found = pieces.groupBy("gid").applyInArrow(finish, "gid long, auc array<double>").join(F.broadcast(groups), "gid")
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, names)], F.col("which").alias("score"), "auc")


def tied(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Two runs of the same one score."""
    p, n = one[0] + two[0], one[1] + two[1]
    return np.stack([p, n, p * n / 2])


def paired_bootstrap(df: DataFrame, one: str, two: str, label: str, block: Sequence[str], by: Sequence[str] = (), draws: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """by..., auc1, auc2, diff, sd, low and high (2.5 and 97.5 percent of the draws' differences), p (two-sided, at least one draw),
    se (of the paired test, which takes rows as independent) and design_effect, sd over se.

    Rows that lack one of the scores or the label are left out; sd and the rest are null with fewer than two draws of both classes.
    """
    scratch = scratch or Scratch(df.sparkSession)
    by = list(by)
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(ok(one) & ok(two) & F.col(label).isNotNull())
    aucs = scratch.keep(weighted_aurocs(rows, [one, two], label, block, by, draws, scratch), "aucs")
    side = lambda s, n: aucs.where(F.col("score") == s).select(*by, F.col("auc").alias(n))
    both = join_same(side(one, "a1"), side(two, "a2"), by).withColumn("d", F.zip_with("a1", "a2", lambda x, y: x - y))
    drawn = F.filter(F.slice("d", 2, draws), lambda x: x.isNotNull())
    spread = both.select(*by, F.col("a1")[0].alias("auc1"), F.col("a2")[0].alias("auc2"), F.col("d")[0].alias("diff"), F.array_sort(drawn).alias("s"))
    n, mean = F.size("s"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    sd = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))

    def quantile(q: float):  # linear between the nearest two
        at = (n - 1) * q
        low = F.floor(at).cast("int")
        return F.get("s", low) + (F.get("s", F.least(low + 1, n - 1)) - F.get("s", low)) * (at - low)

    below = F.size(F.filter("s", lambda x: x <= 0))
    above = F.size(F.filter("s", lambda x: x >= 0))
    p = F.greatest(1.0 / n, F.least(F.lit(1.0), 2.0 * F.least(below, above) / n))
    enough = lambda c: F.when(n > 1, c)
    out = spread.select(*by, "auc1", "auc2", "diff", enough(sd).alias("sd"), enough(quantile(0.025)).alias("low"), enough(quantile(0.975)).alias("high"), enough(p).alias("p"))
    paired = stats.delong(rows, one, two, label, by).select(*by, "se")
    return join_same(out, paired, by).withColumn("design_effect", F.col("sd") / F.nullif(F.col("se"), F.lit(0.0)))


def weighted_means(df: DataFrame, value: str, block: Sequence[str], draws: int) -> DataFrame:
    """draw (0: all rows once) and mean, of ``draws`` Poisson draws of whole blocks: a block's weights in all draws are one row of
    a matrix in the task that has its sum. Draws without a block have a null mean."""
    sums = df.groupBy(*block).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).cast("double").alias("_n")).select(F.xxhash64(*block).alias("h"), "_s", "_n").where("_n > 0")
    order = np.arange(draws + 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, draws + 1))
        for batch in batches:
            h, s, n = (c.to_numpy() for c in batch.columns)
            for at in range(0, len(h), HELD):
                w = draw_weights(h[at : at + HELD], order)
                total += np.stack([s[at : at + HELD] @ w, n[at : at + HELD] @ w])
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["draw", "s", "n"])

    found = sums.mapInArrow(draw, "draw int, s double, n double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return found.select("draw", (F.col("s") / F.nullif(F.col("n"), F.lit(0.0))).alias("mean"))
