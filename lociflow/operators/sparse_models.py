"""Logistic models on sparse counts, for all groups and folds at once.

A row's features are cells (row, feature, count); a group's features have one weight for each held-out fold. Steps are those of L-BFGS.
While the weights of all models of a group fit into a broadcast, each row holds its cells, packed in bytes, and a group's weights and
direction are sent to its rows alone: predictors, losses and gradients are made where the rows are. Nothing of the rows' number is sent
or shuffled in a step; the driver has weights and gradients of that bounded vocabulary, and their history in files. Texts are counted into packed rows by
one job, so that cells are never a table of their own.

A larger vocabulary, of any size, is joined: the weights, gradients and history are a table with a row for each feature. A step joins the
search direction with the cells and sums it per row, and joins the residuals with the cells and sums the gradient per feature; the
driver sees the dot products of that table's columns, from which the two-loop recursion gives the coefficients of the direction. A
side of a join is broadcast only where its stored rows were counted. Tables and shuffled files of a step go when the next has its own.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.sources.scratch import BROADCAST_BYTES, Scratch, batches_of, bounded, shuffles_dropped

#: Step lengths that are tried along a direction.
STEPS = tuple(2.0**i for i in range(3, -21, -1))
#: Letters whose k-mers, and cells whose products, a task holds at a time.
LETTERS, CELLS = 500_000, 1 << 18
#: Rows with their cells that a task exchanges with Python at a time.
ROWS = 500
#: Features whose sums are one row of a shuffle.
BLOCK = 8_192


def kmer_cells(df: DataFrame, row: str, seq: str, sizes: Sequence[int], per: float | None = None) -> DataFrame:
    """row, k, kmer and n: how often each string of k letters occurs in a sequence, overlaps included. Null sequences and those
    shorter than k have none; letters keep their case. With ``per`` n is the share of the sequence's k-mers, times ``per``."""
    kind = dict(df.dtypes)[row]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, to in _spans(texts):
                for k in sizes:
                    which, names, n = count_kmers(texts[at:to], k)
                    if len(n):
                        if per is not None:
                            n = n * float(per) / (np.array([len(t) for t in texts[at:to]])[which] + 1 - k)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which + at)), pa.array(np.full(len(n), k, np.int32)), names, pa.array(n)], names=["row", "k", "kmer", "n"])

    return df.select(F.col(row), F.col(seq).cast("string")).mapInArrow(count, f"row {kind}, k int, kmer string, n {'long' if per is None else 'double'}")


def _spans(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Cuts between texts, so that LETTERS are together, or one text."""
    ends, at = np.cumsum([len(t) for t in texts]), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
        yield at, to
        at = to


def _windows(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of all windows of k letters inside a text the place of that text and the window as a number, and the letters that these are made
    of; none where there are too many letters for one number."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    there = np.bincount(letters) > 0
    alphabet, letter = np.flatnonzero(there), (np.cumsum(there) - 1)[letters]
    if max(1, len(alphabet)) ** k * max(1, len(texts)) >= 1 << 62:
        return None
    windows = max(0, len(letters) - k + 1)
    key = np.zeros(windows, np.int64)
    for j in range(k):
        key = key * len(alphabet) + letter[j : j + windows]
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:windows] == owner[k - 1 : k - 1 + windows]
    return owner[:windows][inside], key[inside], alphabet


def _spelt(codes: np.ndarray, alphabet: np.ndarray, k: int) -> pa.Array:
    letters = np.stack([alphabet[codes // len(alphabet) ** (k - 1 - j) % len(alphabet)] for j in range(k)], axis=1) if len(codes) else np.zeros((0, k))
    names = letters.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([names[i : i + k] for i in range(0, len(names), k)], pa.string())


def distinct_kmers(texts: Sequence[str], k: int) -> pa.Array:
    found = _windows(texts, k)
    if found is None:
        return pa.array(list({t[j : j + k] for t in texts for j in range(len(t) - k + 1)}), pa.string())
    return _spelt(np.unique(found[1]), found[2], k)


def coded_kmers(texts: Sequence[str], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The place of a text, and the place of a k-mer among the distinct ones, which are the second value, and how often it occurs there."""
    found = _windows(texts, k)
    if found is None:
        each = [(i, m, n) for i, t in enumerate(texts) for m, n in Counter(t[j : j + k] for j in range(len(t) - k + 1)).items()]
        names = {m: j for j, m in enumerate(dict.fromkeys(m for _, m, _ in each))}
        return np.array([i for i, _, _ in each], np.int64), pa.array(list(names), pa.string()), np.array([names[m] for _, m, _ in each], np.int64), np.array([n for _, _, n in each], np.int64)
    owner, key, alphabet = found
    base = max(1, len(alphabet)) ** k
    key, n = np.unique(owner * base + key, return_counts=True)
    codes, where = np.unique(key % base, return_inverse=True)
    return key // base, _spelt(codes, alphabet, k), where, n


def count_kmers(texts: Sequence[str], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The place of a text, a k-mer and how often it occurs there, for all that do."""
    which, names, where, n = coded_kmers(texts, k)
    return which, names.take(pa.array(where)), n


def _gathered(each):
    """Small batches of ``each`` put together to larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in each(batches):
            held.append(batch)
            if sum(b.num_rows for b in held[-64:]) > 50_000 or len(held) > 2_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _summed(df: DataFrame, make, groups: Sequence[int], size: int) -> dict[int, np.ndarray]:
    """Per group the sum over all rows of a vector of ``size`` numbers, which ``make`` gives for a batch as {group: vector}."""
    schema = pa.schema([("group", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for g, v in make(batch).items():
                    total[g] = total.get(g, 0) + v
        for g, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, g), pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array(v)], schema=schema)

    found = {g: np.zeros(size) for g in groups}
    for r in df.mapInArrow(sums, "group int, at int, value double").groupBy("group", "at").agg(F.sum("value").alias("value")).collect():  # ``size`` rows a group
        found[r.group][r["at"]] = r.value
    return found


def _rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def direction(gram: np.ndarray, memory: int, valid: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction in the basis (steps, changes of the gradient, gradient), newest first, from the dot
    products of the basis."""
    s, y, g = range(memory), range(memory, 2 * memory), 2 * memory
    used = [i for i in range(valid) if gram[s[i], y[i]] > 1e-14 * max(1e-300, gram[y[i], y[i]])]
    q, alpha = np.zeros(2 * memory + 1), {}
    q[g] = 1.0
    for i in used:
        alpha[i] = gram[s[i], : 2 * memory + 1] @ q / gram[s[i], y[i]]
        q[y[i]] -= alpha[i]
    if used:
        q *= gram[s[used[0]], y[used[0]]] / gram[y[used[0]], y[used[0]]]
    for i in reversed(used):
        q[s[i]] += alpha[i] - gram[y[i], : 2 * memory + 1] @ q / gram[s[i], y[i]]
    return -q


def leave_out(folds: int, together: int = 1) -> list[tuple[int, ...]]:
    """The sets of up to ``together`` folds, single ones first and in order: what each of a series of models leaves out."""
    return [h for n in range(1, together + 1) for h in combinations(range(folds), n)]


def fit_folds(rows: DataFrame, cells: DataFrame, held: Sequence[Sequence[int]], l2: float = 1.0, memory: int = 6, steps: int = 300, tolerance: float = 1e-6, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """For each group and set of folds in ``held`` the model on all rows of the other folds, all fitted together.

    ``rows``: row (unique), group (int, few), fold, label (0 or 1). ``cells``: row, group, feature, n; a feature
    belongs to one group and an id below 0 to none. Minimises the negative log likelihood plus ``l2`` / 2 times the squared weights; the intercept,
    feature -1 - group, is free. Ends when each model's gradient is below ``tolerance`` of its first one, or its loss
    can't fall further. Returns the weights (group, feature, w with one for each of ``held``) and the rows with ``z``, their
    linear predictors under each model. A model whose rows have one class, or which has none, has null weights and predictors.
    """
    folds = len(held)  # the models are numbered as the folds where each leaves out one
    scratch = scratch or Scratch(rows.sparkSession)
    rows = scratch.keep(rows.where(F.col("label").isNotNull() & F.col("fold").isNotNull()).select(F.col("row"), F.col("group").cast("int"), F.col("fold").cast("int"), F.col("label").cast("double")), "rows")
    counted = rows.groupBy("group", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()  # few groups, folds
    groups, live = _live(counted, held)
    intercepts = rows.select("row", "group", (F.lit(-1) - F.col("group")).cast("long").alias("feature"), F.lit(1.0).alias("n"))
    cells = cells.select("row", F.col("group").cast("int"), F.col("feature").cast("long"), F.col("n").cast("double")).join(rows.select("row"), "row", "left_semi")
    cells = scratch.keep(cells.unionByName(intercepts), "cells")
    blocks, width = 2 * memory + 2, 2 * memory + 2  # gradient, weights, steps and changes; basis and weights
    free = F.col("feature") < 0
    features = cells.select("group", "feature").distinct().withColumns({"penalty": F.when(free, 0.0).otherwise(float(l2)), "state": F.array_repeat(F.lit(0.0), blocks * folds)})
    features = scratch.renew(features, "features")
    # neither side's number of rows changes from step to step
    send = {n: F.broadcast if size * (8 * folds + 64) <= BROADCAST_BYTES else (lambda df: df) for n, size in (("features", features.count()), ("rows", rows.count()))}
    zeros = F.array_repeat(F.lit(0.0), folds)
    margins = rows.withColumn("z", zeros)
    p_of = lambda z: 1 / (1 + F.exp(-z))

    def gradient(margins: DataFrame) -> DataFrame:
        wrong = F.zip_with("z", F.array(*[~F.col("fold").isin(list(h)) for h in held]), lambda z, own: F.when(own, p_of(z) - F.col("label")).otherwise(0.0))
        residual = margins.select("row", wrong.alias("r"))
        return cells.join(send["rows"](residual), "row").groupBy("feature").agg(F.array(*[F.sum(F.col("n") * F.col("r")[f]) for f in range(folds)]).alias("sums"))

    def losses(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        return _losses(_rows_of(batch, "z"), _rows_of(batch, "dz"), batch.column("group").to_numpy(), y, _own(fold, held))

    features = _updated(features, gradient(margins), {g: np.zeros((folds, blocks - 1)) for g in groups}, folds, memory, scratch)
    first, done, valid = {}, {g: ~live[g] for g in groups}, 0
    for _ in range(steps):
        dots, along = _directions(features, groups, folds, memory, first, done, valid, tolerance)
        if all(d.all() for d in done.values()):
            break
        moved = features.select("feature", _combined(along, blocks, folds).alias("d"))
        dz = cells.join(send["features"](moved), "feature").groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("d")[f]) for f in range(folds)]).alias("dz"))
        margins = scratch.renew(margins.join(dz, "row"), "margins")
        loss = {g: v.reshape(folds, -1) for g, v in _summed(margins, losses, groups, folds * (len(STEPS) + 1)).items()}
        length = _lengths(loss, dots, along, groups, folds, memory, done)
        margins = margins.select("row", "group", "fold", "label", F.zip_with("z", F.zip_with("dz", _per_group(length), lambda d, t: d * t), lambda z, d: z + d).alias("z"))
        features = _updated(features, gradient(margins), {g: along[g] * length[g][:, None] for g in groups}, folds, memory, scratch)
        valid += 1
    known = {g: np.where(live[g], 0.0, np.nan) for g in groups}
    keep = lambda c: F.zip_with(c, _per_group(known), lambda x, ok: F.when(~F.isnan(ok), x))
    weights = F.slice("state", (blocks - 1) * folds + 1, folds)
    return features.select("group", "feature", keep(weights).alias("w")), margins.select("row", "group", "fold", "label", keep(F.col("z")).alias("z"))


def _live(counted: Sequence, held: Sequence[Sequence[int]]) -> tuple[list[int], dict[int, np.ndarray]]:
    """The groups, and which models of each have rows of both classes, from the rows and positives of groups and folds."""
    groups = sorted({r.group for r in counted})
    rest = lambda g, h: [sum(x) for x in zip(*((r.p, r.n - r.p) for r in counted if r.group == g and r.fold not in h))] or [0, 0]
    return groups, {g: np.array([min(rest(g, h)) > 0 for h in held]) for g in groups}


def _updated(features: DataFrame, sums: DataFrame, along: dict[int, np.ndarray], folds: int, memory: int, scratch: Scratch) -> DataFrame:
    """The features' state at a new point: ``along`` has, per group, each fold's coefficients of the step taken in the old basis."""
    blocks = 2 * memory + 2  # gradient, weights, steps and changes
    schema = pa.schema([("group", pa.int32()), ("feature", pa.int64()), ("penalty", pa.float64()), ("state", pa.list_(pa.float64()))])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state = _rows_of(batch, "state").reshape(-1, blocks, folds)
            group = batch.column("group").to_numpy()
            step = np.zeros((len(state), folds))
            for g in np.unique(group).tolist():
                step[group == g] = np.einsum("nbf,fb->nf", state[group == g][:, : blocks - 1], along[g])
            new = np.empty_like(state)
            new[:, blocks - 1] = state[:, blocks - 1] + step
            new[:, 2 * memory] = _rows_of(batch, "sums") + batch.column("penalty").to_numpy()[:, None] * new[:, blocks - 1]
            new[:, 1:memory], new[:, memory + 1 : 2 * memory] = state[:, : memory - 1], state[:, memory : 2 * memory - 1]
            new[:, 0], new[:, memory] = step, new[:, 2 * memory] - state[:, 2 * memory]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(new) + 1) * blocks * folds, blocks * folds), pa.int32()), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("group", "feature", "penalty")], flat], schema=schema)

    joined = features.join(sums, "feature", "left").withColumn("sums", F.coalesce("sums", F.array_repeat(F.lit(0.0), folds)))
    return scratch.renew(joined.mapInArrow(move, "group int, feature long, penalty double, state array<double>"), "features")


def _directions(features: DataFrame, groups: Sequence[int], folds: int, memory: int, first: dict, done: dict, valid: int, tolerance: float) -> tuple[dict, dict]:
    """Per group the dot products of its state and each open model's coefficients of the direction; ``first`` and ``done`` are kept up."""
    blocks, width = 2 * memory + 2, 2 * memory + 2  # gradient, weights, steps and changes; basis and weights

    def grams(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        state, group, penalty = _rows_of(batch, "state").reshape(-1, blocks, folds), batch.column("group").to_numpy(), batch.column("penalty").to_numpy()
        found = {}
        for g in np.unique(group).tolist():
            x = state[group == g].transpose(2, 1, 0)
            found[g] = np.stack([x @ x.transpose(0, 2, 1), (x * penalty[group == g]) @ x.transpose(0, 2, 1)]).ravel()
        return found

    dots = {g: v.reshape(2, folds, width, width) for g, v in _summed(features, grams, groups, 2 * folds * width * width).items()}
    along = {g: np.zeros((folds, blocks - 1)) for g in groups}
    for g in groups:
        size = np.sqrt(np.maximum(0, dots[g][0, :, 2 * memory, 2 * memory]))
        first.setdefault(g, np.maximum(1.0, size))
        done[g] = done[g] | (size <= tolerance * first[g])
        for f in np.flatnonzero(~done[g]):
            gram = dots[g][0, f, : blocks - 1, : blocks - 1]
            along[g][f] = direction(gram, memory, min(valid, memory))
            if gram[2 * memory] @ along[g][f] >= 0:
                along[g][f] = -np.eye(blocks - 1)[2 * memory]
    return dots, along


def _lengths(loss: dict, dots: dict, along: dict, groups: Sequence[int], folds: int, memory: int, done: dict) -> dict[int, np.ndarray]:
    """The step length of least loss of each open model; one that can't fall further is done."""
    blocks = 2 * memory + 2
    length = {g: np.zeros(folds) for g in groups}
    for g in groups:
        for f in np.flatnonzero(~done[g]):
            c, weights = along[g][f], dots[g][1, f]
            uu, up, pp = weights[-1, -1], weights[-1, : blocks - 1] @ c, c @ weights[: blocks - 1, : blocks - 1] @ c
            length[g][f] = _length(loss[g][f], uu, up, pp)
            done[g][f] |= length[g][f] == 0  # rounding alone is left
    return length


def _length(loss: np.ndarray, uu: float, up: float, pp: float) -> float:
    """The step length of least loss with its penalty, whose parts are of the weights, of both and of the direction."""
    total = [v + (uu + 2 * t * up + t * t * pp) / 2 for t, v in zip((0.0, *STEPS), loss)]
    return (0.0, *STEPS)[int(np.argmin(total))]


def _own(fold: np.ndarray, held: Sequence[Sequence[int]]) -> np.ndarray:
    """Which models learn from the rows of these folds."""
    return np.stack([~np.isin(fold, list(h)) for h in held], axis=1)


def _losses(z: np.ndarray, dz: np.ndarray, group: np.ndarray, y: np.ndarray, own: np.ndarray) -> dict[int, np.ndarray]:
    """Per group, model and step length the negative log likelihood of the rows."""
    found = {g: np.zeros((z.shape[1], len(STEPS) + 1)) for g in np.unique(group).tolist()}
    for i, t in enumerate((0.0, *STEPS)):
        at = z + t * dz
        loss = (np.logaddexp(0, at) - y[:, None] * at) * own
        for g, v in found.items():
            v[:, i] += loss[group == g].sum(axis=0)
    return {g: v.ravel() for g, v in found.items()}


def _bytes_of(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 - 1 as their lowest bytes, then the next ones and so on to the last that are not all 0."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return planes[: 4 - int(np.argmax(planes[::-1].any(axis=1))) if planes.any() else 0].tobytes()


def _numbers_of(held: Sequence[bytes], sizes: Sequence[int]) -> np.ndarray:
    """The numbers of all rows, one after another."""
    found = np.zeros((sum(sizes), 4), np.uint8)
    at = 0
    for x, size in zip(held, sizes):
        for i in range(len(x) // size if size else 0):
            found[at : at + size, i] = np.frombuffer(x, np.uint8, size, i * size)
        at += size
    return found.view("<u4")[:, 0]


def packed(used: DataFrame, sizes: Sequence[int], names, per: float | None) -> DataFrame:
    """Rows (row, group, fold, label) for each k, with ``size``, ``at`` and ``n``: how many distinct k-mers a text has, the gaps between
    their places in ``names`` of k, in order, and how often they occur; what ``per`` makes of one occurrence is ``each``."""
    kind = used.schema["row"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("seq").to_pylist()]
            for a, b in _spans(texts):
                lengths = np.array([len(t) for t in texts[a:b]])
                for k in sizes:
                    which, own, where, n = coded_kmers(texts[a:b], k)
                    at = pc.index_in(own, value_set=names.value[k]).to_numpy(zero_copy_only=False).astype(np.int64)[where]
                    order = np.argsort(which * (len(names.value[k]) + 1) + at)
                    at, n = at[order], n[order]
                    ends = np.cumsum(np.bincount(which, minlength=b - a))
                    cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                    each = np.ones(b - a) if per is None else float(per) / np.maximum(1, lengths + 1 - k)
                    gaps = [pa.array([_bytes_of(np.diff(at[i:j], prepend=0)) for i, j in cuts], pa.binary()), pa.array([_bytes_of(n[i:j]) for i, j in cuts], pa.binary())]
                    known = [batch.column("row").slice(a, b - a), pa.array(np.full(b - a, k, np.int32)), *[batch.column(c).slice(a, b - a) for c in ("fold", "label")]]
                    yield pa.RecordBatch.from_arrays([*known, pa.array(np.diff(ends, prepend=0), pa.int32()), pa.array(each), *gaps], names=["row", "group", "fold", "label", "size", "each", "at", "n"])

    return used.mapInArrow(pack, f"row {kind}, group int, fold int, label double, size int, each double, at binary, n binary")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's rows in parts of about CELLS cells: their slice, their cells' features and numbers, and how many cells each row has."""
    sizes, each = batch.column("size").to_numpy().astype(np.int64), batch.column("each").to_numpy()
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, side="right")))
        own = sizes[a:b]
        gaps, n = (_numbers_of(batch.column(c).slice(a, b - a).to_pylist(), own.tolist()) for c in ("at", "n"))
        at = np.cumsum(gaps, dtype=np.int64)
        if len(at):  # over all rows; each begins anew
            at -= np.repeat(np.concatenate([[0], at])[np.cumsum(own) - own], own)
        yield slice(a, b), at, n * np.repeat(each[a:b], own), own
        a = b


def _predictors(part: tuple, weights: np.ndarray) -> np.ndarray:
    """Of the part's rows under each model; the last weight is the intercept."""
    _, at, n, sizes = part
    z = np.repeat(weights[:, -1][None, :], len(sizes), axis=0)
    some = np.flatnonzero(sizes)  # a text may have no cells
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for f, own in enumerate(weights):
            z[some, f] += np.add.reduceat(own.take(at) * n, starts)
    return z


class _History:
    """A model's last steps and changes of its gradient: files of the driver, of which it holds one at a time."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.pairs, self.added = folder, memory, [], 0

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        at = [f"{self.folder}-{x}{self.added % self.memory}.npy" for x in "sy"]  # in place of the oldest ones
        for name, x in zip(at, (s, y)):
            np.save(name, x)
        self.pairs, self.added = [(*at, s @ y, y @ y), *self.pairs][: self.memory], self.added + 1

    def descent(self, gradient: np.ndarray) -> np.ndarray:
        """The L-BFGS direction, by two loops from the newest to the oldest and back."""
        q, alpha = gradient.copy(), []
        used = [p for p in self.pairs if p[2] > 1e-14 * max(1e-300, p[3])]
        for s, y, sy, _ in used:
            alpha.append(np.load(s) @ q / sy)
            q -= alpha[-1] * np.load(y)
        if used:
            q *= used[0][2] / used[0][3]
        for (s, y, sy, _), a in zip(reversed(used), reversed(alpha)):
            q += (a - np.load(y) @ q / sy) * np.load(s)
        return -q if gradient @ q > 0 else -gradient


def _fit_gathered(whole: DataFrame, features: dict[int, int], held: Sequence[Sequence[int]], l2: float, memory: int, steps: int, tolerance: float, scratch: Scratch) -> tuple[dict[int, np.ndarray], DataFrame]:
    """``fit_folds`` on rows that hold their cells, as ``packed`` makes them, with ``features`` a group: its weights, a row for each model
    with the intercept last, and the rows with ``z``."""
    folds, context = len(held), whole.sparkSession.sparkContext
    counted = whole.groupBy("group", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), F.sum(F.col("size").cast("long")).alias("cells")).collect()  # few groups, folds
    groups, live = _live(counted, held)
    cells = {g: sum(r.cells for r in counted if r.group == g) for g in groups}
    # a task's sums have every feature of its group, so that there are not more tasks than keep the cores busy
    parts = {g: max(1, round(context.defaultParallelism * cells[g] / max(1, sum(cells.values())))) for g in groups}
    rows = {g: whole.where(F.col("group") == g).coalesce(parts[g]) for g in groups}
    read = {g: df.select("fold", "label", "size", "each", "at", "n") for g, df in rows.items()}
    weights = {g: np.zeros((folds, features.get(g, 0) + 1)) for g in groups}
    penalty = {g: np.append(np.full(features.get(g, 0), float(l2)), 0.0) for g in groups}

    def losses(sent: dict, open_: Sequence[int]) -> dict[int, np.ndarray]:
        def each(g: int):
            def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = np.zeros(folds * (len(STEPS) + 1))
                for batch in batches:
                    label, own = batch.column("label").to_numpy(), _own(batch.column("fold").to_numpy(), held)
                    for part in _parts(batch):
                        z, dz = (_predictors(part, x) for x in sent[g].value)
                        found += _losses(z, dz, np.zeros(len(z), np.int64), label[part[0]], own[part[0]])[0]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([found.tolist()])], names=["group", "loss"])

            return total

        found = {g: np.zeros(folds * (len(STEPS) + 1)) for g in open_}
        for r in reduce(DataFrame.unionAll, [read[g].mapInArrow(each(g), "group int, loss array<double>") for g in open_]).collect():  # a row a task
            found[r.group] += np.array(r.loss)
        return {g: v.reshape(folds, -1) for g, v in found.items()}

    def gradients(sent: dict, length: dict[int, np.ndarray], open_: Sequence[int]) -> dict[int, np.ndarray]:
        """At the weights sent and so far along the direction sent, without the penalty."""

        def each(g: int):
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, d = sent[g].value
                w = w + d * length[g][:, None]
                sums = np.zeros_like(w)
                for batch in batches:
                    label, own = batch.column("label").to_numpy(), _own(batch.column("fold").to_numpy(), held)
                    for part in _parts(batch):
                        which, at, n, sizes = part
                        z = np.clip(_predictors(part, w), -700, 700)
                        wrong = np.where(own[which], 1 / (1 + np.exp(-z)) - label[which, None], 0.0)
                        sums[:, -1] += wrong.sum(axis=0)
                        for f in range(folds):
                            sums[f] += np.bincount(at, np.repeat(wrong[:, f], sizes) * n, sums.shape[1])
                for i in range(0, sums.shape[1], BLOCK):
                    if (own := sums[:, i : i + BLOCK]).any():
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([i], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["group", "first", "sums"])

            return add

        def total(block: pa.Table) -> pa.Table:
            held_ = block.column("sums")
            return block.slice(0, 1).set_column(2, "sums", pa.array([sum(np.frombuffer(x.as_buffer()) for x in held_).tobytes()], pa.binary()))

        kind = "group int, first long, sums binary"
        partial = reduce(DataFrame.unionAll, [read[g].mapInArrow(each(g), kind) for g in open_])
        found = {g: np.zeros_like(weights[g]) for g in open_}
        for batch in partial.groupBy("group", "first").applyInArrow(total, kind).toArrow().to_batches():  # no more than a broadcast holds
            for g, i, sums in zip(*(c.to_pylist() for c in batch.columns)):
                found[g][:, i : i + BLOCK] = np.frombuffer(sums).reshape(folds, -1)
        return found

    send = lambda d, open_: {g: context.broadcast((weights[g], d[g])) for g in open_}
    sent = send({g: np.zeros((folds, 1)) for g in groups}, groups)
    gradient = gradients(sent, {g: np.zeros(folds) for g in groups}, groups) if groups else {}
    first = {g: np.maximum(1.0, np.linalg.norm(v, axis=1)) for g, v in gradient.items()}
    folder, done = tempfile.TemporaryDirectory(), {g: ~live[g] for g in groups}
    history = {g: [_History(f"{folder.name}/{g}-{f}", memory) for f in range(folds)] for g in groups}
    for _ in range(steps):
        for s in sent.values():
            s.destroy()  # its file on the driver goes, too
        for g in groups:
            done[g] = done[g] | (np.linalg.norm(gradient[g], axis=1) <= tolerance * first[g])
        open_ = [g for g in groups if not done[g].all()]
        if not open_:
            sent = {}
            break
        d = {g: np.stack([np.zeros(len(penalty[g])) if done[g][f] else history[g][f].descent(gradient[g][f]) for f in range(folds)]) for g in open_}
        sent = send(d, open_)
        loss, length = losses(sent, open_), {}
        for g in open_:
            length[g] = np.zeros(folds)
            for f in np.flatnonzero(~done[g]):
                u, p = weights[g][f], d[g][f]
                length[g][f] = _length(loss[g][f], penalty[g] @ (u * u), penalty[g] @ (u * p), penalty[g] @ (p * p))
                done[g][f] |= length[g][f] == 0  # rounding alone is left
        found = gradients(sent, length, open_)
        for g in open_:
            weights[g] = weights[g] + d[g] * length[g][:, None]
            found[g] += penalty[g] * weights[g]
            for f in np.flatnonzero(~done[g]):
                history[g][f].add(d[g][f] * length[g][f], found[g][f] - gradient[g][f])
            gradient[g] = found[g]
    for s in sent.values():
        s.destroy()
    folder.cleanup()
    kind = whole.schema["row"].dataType.simpleString()
    own = {g: context.broadcast(weights[g]) for g in groups}

    def final(g: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = np.concatenate([_predictors(part, own[g].value) for part in _parts(batch)])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(z) + 1) * folds, folds), pa.int32()), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "group", "fold", "label")], flat], names=["row", "group", "fold", "label", "z"])

        return place

    out = f"row {kind}, group int, fold int, label double, z array<double>"
    if not groups:
        return {}, whole.sparkSession.createDataFrame([], out)
    margins = scratch.keep(reduce(DataFrame.unionAll, [rows[g].mapInArrow(final(g), out) for g in groups]), "margins")
    for s in own.values():
        s.destroy()
    known = {g: np.where(live[g], 0.0, np.nan) for g in groups}
    keep = F.zip_with("z", _per_group(known), lambda x, ok: F.when(~F.isnan(ok), x))
    return {g: np.where(live[g][:, None], w, np.nan) for g, w in weights.items()}, margins.select("row", "group", "fold", "label", keep.alias("z"))


def _per_group(values: dict[int, np.ndarray]) -> Column:
    """An array of the few folds' numbers for the row's group."""
    return F.coalesce(*[F.when(F.col("group") == g, F.array(*[F.lit(float(x)) for x in v])) for g, v in values.items()]) if values else F.array().cast("array<double>")


def _combined(along: dict[int, np.ndarray], blocks: int, folds: int) -> Column:
    """The direction's weights of a feature."""

    @F.pandas_udf("array<double>")
    def combine(state, group):
        import pandas as pd

        x = np.stack(state.to_numpy()).reshape(-1, blocks, folds)[:, : blocks - 1]
        found = np.zeros((len(x), folds))
        for g in group.unique():
            at = (group == g).to_numpy()
            found[at] = np.einsum("nbf,fb->nf", x[at], along[int(g)])
        return pd.Series(list(found))

    return combine("state", "group")


def out_of_fold(margins: DataFrame) -> DataFrame:
    """row, group, fold, label and score, the predictor of the model that did not see the row's fold; the first models leave out
    one fold each, in order."""
    return margins.select("row", "group", "fold", "label", F.get("z", "fold").alias("score"))


def cross_fitted(margins: DataFrame, folds: int) -> DataFrame:
    """row, group, fold, label, outer and score, a row for each outer fold: the predictor of the model that saw neither the row's
    fold nor the outer one. ``margins`` are of the models of ``leave_out(folds, 2)``."""
    number = {h: i for i, h in enumerate(leave_out(folds, 2))}
    place = F.element_at(F.array(*[F.array(*[F.lit(number[tuple(sorted({i, j}))]) for j in range(folds)]) for i in range(folds)]), F.col("outer") + 1)[F.col("fold")]
    every = margins.withColumn("outer", F.explode(F.array(*map(F.lit, range(folds)))))
    return every.select("row", "group", "fold", "label", "outer", F.get("z", place).alias("score"))


def encoded(cells: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Cells (row, k, kmer, n) with ``feature``, a number for each k-mer, and the vocabulary k, kmer, feature."""
    vocabulary = scratch.keep(cells.select("k", "kmer").distinct().withColumn("feature", F.monotonically_increasing_id()), "vocabulary")
    return cells.join(bounded(vocabulary, 96), ["k", "kmer"]), vocabulary


def vocabulary_of(used: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """k, kmer and m, in how many spans of texts it was seen: all k-mers of the texts in ``seq``."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in _spans(texts):
                for k in sizes:
                    names = distinct_kmers(texts[a:b], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k, np.int32)), names], names=["k", "kmer"])

    return used.select("seq").mapInArrow(spell, "k int, kmer string").groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("m"))


def kmer_models(df: DataFrame, row: str, seq: str, label: str, fold: str, folds: int, sizes: Sequence[int], together: int = 1, per: float | None = None, scratch: Scratch | None = None, l2: float = 1.0, memory: int = 6, steps: int = 300, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """One model for each k-mer size and held-out fold, all fitted together: the weights (k, kmer, w; the intercept's k-mer is
    null) and the rows' predictors (row, group, fold, label, z), for ``out_of_fold``; ``group`` is k. With ``together`` of 2 also the
    models that leave out two folds, for ``cross_fitted``. With ``per`` a k-mer counts by its share of the sequence's, times ``per``, so
    that sequences of any length compare.

    The vocabulary is that of all sequences; a k-mer that a model's rows lack weighs 0. Rows with null label, fold or row take no
    part; a sequence without k-mers has the intercept alone. Rows are unique.
    """
    scratch, spark, held = scratch or Scratch(df.sparkSession), df.sparkSession, leave_out(folds, together)
    used = df.select(F.col(row).alias("row"), F.col(seq).cast("string").alias("seq"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("label")).dropna(subset=["row", "fold", "label"])
    with shuffles_dropped(spark):
        vocabulary = scratch.keep(vocabulary_of(used, sizes), "vocabulary")
        features = {r.k: r["count"] for r in vocabulary.groupBy("k").count().collect()}  # the few sizes
        bytes_ = [(1 + features.get(k, 0)) * 8 * len(held) for k in sizes]
        if max(bytes_) > BROADCAST_BYTES or sum(bytes_) > 2 * BROADCAST_BYTES:
            return _joined_models(used, sizes, held, per, scratch, l2=l2, memory=memory, steps=steps, tolerance=tolerance)
        found = vocabulary.toArrow().sort_by([("m", "descending"), ("kmer", "ascending")])  # frequent ones have small numbers
        names = {k: found.filter(pc.equal(found["k"], k))["kmer"].combine_chunks() for k in sizes}
        sent = spark.sparkContext.broadcast(names)
        with batches_of(spark, ROWS):
            whole = scratch.keep(packed(used, sizes, sent, per), "whole", ["group"], "zstd")
            own, margins = _fit_gathered(whole, features, held, l2, memory, steps, tolerance, scratch)
    own = spark.sparkContext.broadcast(own)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, w = batch.column("k").to_numpy(), np.zeros((batch.num_rows, len(held)))
            for k in np.unique(size).tolist():
                rows = np.flatnonzero(size == k)
                at = pc.index_in(batch.column("kmer").take(pa.array(rows)), value_set=sent.value[k]).fill_null(-1)  # the intercept is last
                w[rows] = own.value[k][:, at.to_numpy(zero_copy_only=False)].T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, len(held)), pa.int32()), pa.array(w.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("kmer"), flat], names=["k", "kmer", "w"])

    every = vocabulary.select("k", "kmer").unionByName(spark.createDataFrame([(k, None) for k in own.value], "k int, kmer string"))
    return every.mapInArrow(weigh, "k int, kmer string, w array<double>"), margins


def _joined_models(used: DataFrame, sizes: Sequence[int], held: Sequence[Sequence[int]], per: float | None, scratch: Scratch, **options) -> tuple[DataFrame, DataFrame]:
    """``kmer_models`` for vocabularies of any size, by ``fit_folds``."""
    cells, vocabulary = encoded(scratch.keep(kmer_cells(used, "row", "seq", sizes, per), "kmers"), scratch)
    named = lambda r, k: F.struct(F.col(r).alias("row"), F.col(k).cast("int").alias("k"))
    rows = used.select("row", "fold", "label", F.explode(F.array(*map(F.lit, sizes))).alias("group")).withColumn("row", named("row", "group"))
    cells = cells.select(named("row", "k").alias("row"), F.col("k").alias("group"), "feature", "n")
    weights, margins = fit_folds(rows.select("row", "group", "fold", "label"), cells, held, scratch=scratch, **options)
    weights = weights.join(vocabulary.select("feature", "kmer"), "feature", "left").select(F.col("group").alias("k"), "kmer", "w")
    return weights, margins.select("row.row", "group", "fold", "label", "z")


def scored(cells: DataFrame, folds: DataFrame, weights: DataFrame) -> DataFrame:
    """row, k and score of new sequences under existing models: ``cells`` (row, k, kmer, n), ``folds`` (row, fold), ``weights``
    as of ``kmer_models``. K-mers without a weight add nothing; rows whose fold is null or has no model have a null score."""
    sizes = weights.where("kmer IS NULL").select("k", F.col("w").alias("w0"))
    base = folds.select("row", "fold").join(F.broadcast(sizes))  # one row for each k
    sums = cells.join(weights, ["k", "kmer"]).join(folds, "row").groupBy("row", "k").agg(F.sum(F.col("n") * F.get("w", "fold")).alias("s"))
    return base.join(sums, ["row", "k"], "left").select("row", "k", (F.get("w0", "fold") + F.coalesce("s", F.lit(0.0))).alias("score"))


def variant_delta(variants: DataFrame, weights: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """vid, k and delta: the score of the reference sequence less that of the alternate one, under the model that did not see the
    variant's fold.

    ``variants``: vid (unique), ref_seq, alt_seq, fold. Only the windows that differ count: sequences of one length are cut to
    the k - 1 letters around the letters that differ, for others the common start and end are cut so, as the rest has the same
    k-mers. Null sequences and folds, and folds without a model, have a null delta.
    """
    scratch = scratch or Scratch(variants.sparkSession)
    sizes = [r.k for r in weights.where("kmer IS NULL").select("k").collect()]  # the few sizes
    schema = "vid " + dict(variants.dtypes)["vid"] + ", fold int, k int, kmer string, n long"

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vid, ref, alt, fold in zip(*[c.to_pylist() for c in batch.columns]):
                if ref is None or alt is None or fold is None:
                    continue
                for k in sizes:
                    found: Counter[str] = Counter()
                    for sign, (a, b) in zip((1, -1), changed(ref, alt, k)):
                        text = ref if sign > 0 else alt
                        for i in range(a, b - k + 1):
                            found[text[i : i + k]] += sign
                    if found := {m: n for m, n in found.items() if n}:
                        size = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array([vid] * size, batch.schema.field(0).type), pa.array([fold] * size, pa.int32()), pa.array([k] * size, pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["vid", "fold", "k", "kmer", "n"])

    cells = variants.select("vid", F.col("ref_seq").cast("string"), F.col("alt_seq").cast("string"), F.col("fold").cast("int")).mapInArrow(_gathered(differ), schema)
    weights = scratch.keep(weights, "weights")
    sums = cells.join(bounded(weights, 160), ["k", "kmer"]).groupBy("vid", "k").agg(F.sum(F.col("n") * F.get("w", "fold")).alias("delta"))
    known = weights.where("kmer IS NULL").select("k", "w")
    every = variants.select("vid", "fold", "ref_seq", "alt_seq").join(F.broadcast(known)).join(sums, ["vid", "k"], "left")  # one row for each k
    ok = F.get("w", "fold").isNotNull() & F.col("ref_seq").isNotNull() & F.col("alt_seq").isNotNull()
    return every.select("vid", "k", F.when(ok, F.coalesce("delta", F.lit(0.0))).alias("delta"))


def changed(ref: str, alt: str, k: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The parts of two sequences that hold all their windows of k letters that can differ."""
    start = 0
    while start < min(len(ref), len(alt)) and ref[start] == alt[start]:
        start += 1
    end = 0
    while end < min(len(ref), len(alt)) - start and ref[-1 - end] == alt[-1 - end]:
        end += 1
    first, after = max(0, start - k + 1), max(0, end - k + 1)
    return (first, len(ref) - after), (first, len(alt) - after)
