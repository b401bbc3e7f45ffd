"""Language-model scoring with Brown class-based bigrams.

Words are assigned to classes by exchange clustering, and a token's probability is its class's given the class before,
times the word's within its class; both are smoothed. The core, the most frequent words and the endings of all others,
is clustered first. Every further training word then gets the class that its own neighbours choose against the core's
classes; only words unseen in training belong to the class of their ending. Counts come from all training texts; what
tasks and the driver hold is bounded by the numbers of units, classes and listed words, never by the corpus. The counts
and classes of all words are a table, which the tokens of words that are not listed are joined with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import shared_dir, stored

#: The token that ends every text; no word is empty.
END = b""
#: Weight of a word type in emissions and in the base model, and of the class's share in transitions.
EMISSION, BASE, TRANSITION = 0.1, 0.1, 5.0
#: Bytes of an ending, and distinct words a task counts before it hands its counts on.
ENDING, HELD = 3, 200_000
#: Pairs of units up to which a task counts all of them in one array.
DENSE = 1 << 23
#: Share of the units that may move in a round.
MOVING = 0.3

def tokens(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), END]  # bytes are split at blanks and the bytes 9 to 13, as the word rule is


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Whether the CRC-32 of doc_id as text is divisible by ``folds``; a null doc_id counts as the empty text, so as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def count_words(train: DataFrame) -> DataFrame:
    """word (binary) and c for all tokens of all texts, counted in the tasks first."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
                if len(found) > HELD:
                    # frequent words stay, so that they are handed on once
                    frequent = Counter({w: n for w, n in found.items() if n > 20})
                    rest = [(w, n) for w, n in found.items() if n <= 20]
                    if len(frequent) > HELD // 2:
                        frequent, rest = Counter(), list(found.items())
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rest], pa.binary()), pa.array([n for _, n in rest], pa.int64())], schema=schema)
                    found = frequent
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)

    return train.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """What is clustered: unit 0 is the end, then words, then endings; the last unit takes all other endings."""

    words: list[bytes]
    endings: list[bytes]

    def __post_init__(self) -> None:
        self.word = {END: 0} | {w: 1 + k for k, w in enumerate(self.words)}
        self.ending = {e: 1 + len(self.words) + k for k, e in enumerate(self.endings)}
        self.other = 1 + len(self.words) + len(self.endings)

    def __len__(self) -> int:
        return self.other + 1

    def of(self, word: bytes) -> int:
        found = self.word.get(word)
        return self.ending.get(word[-ENDING:], self.other) if found is None else found


class Memo(dict):
    """word -> unit for the frequent words of a task; bounded."""

    def __init__(self, units: Units):
        self.units = units
        self.update(units.word)

    def __missing__(self, word: bytes) -> int:
        found = self.units.of(word)
        if len(self) < HELD:
            self[word] = found
        return found


def count_pairs(train: DataFrame, units: Units) -> DataFrame:
    """u, v, n: how often unit v follows unit u; the first token of a text follows an end."""
    size = len(units)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(units)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = np.zeros(size * size, np.int64) if size * size <= DENSE else None
        held: list[np.ndarray] = []
        waiting = 0

        def merge() -> None:
            nonlocal keys, counts, waiting
            if every is not None:
                np.add.at(every, np.concatenate([keys, *held]), 1)
                held.clear()
                waiting = 0
                return
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            held.clear()
            waiting = 0
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                held.append(np.concatenate([[0], ids[:-1]]) * size + ids)
                waiting += len(ids)
                if waiting > 2_000_000:
                    merge()
        merge()
        if every is not None:
            keys = np.flatnonzero(every)
            counts = every[keys]
        for at in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500_000]), pa.array(counts[at : at + 500_000])], schema=schema)

    pairs = train.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select((F.col("pair") / size).cast("int").alias("u"), (F.col("pair") % size).cast("int").alias("v"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(own: int, left: np.ndarray, right: np.ndarray, self_pairs: float, between: np.ndarray) -> tuple[int, float]:
    """The class where a unit raises the likelihood of class bigrams most, and by how much against its own class.

    ``left`` and ``right`` count the classes of its neighbours, without itself; ``between`` counts class bigrams.
    """
    rest = between.copy()
    rest[own, :] -= right
    rest[:, own] -= left
    rest[own, own] -= self_pairs
    outer, inner = rest.sum(axis=1) + left, rest.sum(axis=0) + right  # the neighbours' pairs stay theirs in any class
    rows = _xlogx(rest + right[None, :]) - _xlogx(rest)  # row b gains the unit's followers
    columns = _xlogx(rest + left[:, None]) - _xlogx(rest)
    diagonal = np.diag(rest)
    gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns)
    gain += _xlogx(diagonal + left + right + self_pairs) - _xlogx(diagonal)
    n_right, n_left = right.sum() + self_pairs, left.sum() + self_pairs
    gain -= _xlogx(outer + n_right) - _xlogx(outer) + _xlogx(inner + n_left) - _xlogx(inner)
    found = int(gain.argmax())
    return found, float(gain[found] - gain[own])


def best_classes(own: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: np.ndarray, between: np.ndarray) -> np.ndarray:
    """What ``best_class`` finds for many words, a row each, though never the end's class 0; only their own neighbours' classes are visited."""
    rows = np.arange(len(own))
    gain = np.zeros(left.shape)
    for side, other, counts in ((right, left, between.T), (left, right, between)):
        w, k = np.nonzero(side)
        if not len(w):
            continue
        x = side[w, k]
        rest = counts[k].copy()
        rest[np.arange(len(w)), own[w]] -= x
        mine = np.flatnonzero(k == own[w])
        rest[mine] -= other[w[mine]]
        rest[mine, k[mine]] -= self_pairs[w[mine]]
        more = _xlogx(rest + x[:, None]) - _xlogx(rest)
        more[np.arange(len(w)), k] = 0
        starts = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        gain[w[starts]] += np.add.reduceat(more, starts, axis=0)
    n_right, n_left = right.sum(axis=1) + self_pairs, left.sum(axis=1) + self_pairs
    diagonal = np.tile(np.diag(between), (len(own), 1))
    diagonal[rows, own] -= left[rows, own] + right[rows, own] + self_pairs
    gain += _xlogx(diagonal + left + right + self_pairs[:, None]) - _xlogx(diagonal)
    for counts, n in ((between.sum(axis=1), n_right), (between.sum(axis=0), n_left)):
        rest = np.tile(counts, (len(own), 1))
        rest[rows, own] -= n
        gain -= _xlogx(rest + n[:, None]) - _xlogx(rest)
    gain[:, 0] = -np.inf
    found = gain.argmax(axis=1)
    return np.where((own == 0) | (gain[rows, found] > gain[rows, own] + 1e-9), found, own)


def count_neighbours(train: DataFrame, units: Units, unit_class: np.ndarray, classes: int) -> DataFrame:
    """word, key and n, lists of equal length, for all words that are no units, more than one row a word: key a counts tokens after
    class a, ``classes`` + a tokens before class a, and 2 ``classes`` those after the word itself; neighbours have the classes of their
    units."""
    schema = pa.schema([("word", pa.binary()), ("key", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    first, width = len(units.word), 2 * classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of: list[int] = unit_class[:first].tolist()
        further: list[bytes] = []

        class Place(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = place = first + len(further)
                further.append(word)
                class_of.append(int(unit_class[units.of(word)]))
                return place

        place = Place(units.word)
        held: list[np.ndarray] = []
        waiting = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal place, waiting
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            words, starts = np.unique(keys // width, return_index=True)  # one place after another, as the keys are sorted
            ends = np.append(starts[1:], len(keys))
            for at in range(0, len(words), 50_000):
                begun, last = starts[at : at + 50_000], ends[at : at + 50_000][-1]
                offsets = pa.array(np.append(begun, last) - begun[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[begun[0] : last].astype(np.int32))) for v in (keys % width, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([further[w] for w in words[at : at + 50_000].tolist()], pa.binary()), *lists], schema=schema)
            held.clear()
            waiting = 0
            further.clear()
            del class_of[first:]
            place = Place(units.word)

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                k = np.fromiter(map(class_of.__getitem__, at), np.int64, len(words))
                i = np.flatnonzero(at >= first)
                if len(i):
                    base = (at[i] - first) * width
                    before = np.concatenate([[0], at[:-1]])[i]  # the end, which is no further word, stands before the first token
                    after = i + 1  # the end is the last token
                    left = np.where(before == at[i], 2 * classes, np.concatenate([[0], k[:-1]])[i])
                    held += [base + left, (base + classes + k[after])[at[after] != at[i]]]
                    waiting += 2 * len(i)
                if len(further) > 2 * HELD or waiting > 4_000_000:
                    yield from done()
        yield from done()

    return train.select("text").mapInArrow(count, "word binary, key array<int>, n array<int>")


def choose_classes(neighbours: DataFrame, units: Units, unit_class: np.ndarray, between: np.ndarray) -> DataFrame:
    """word, c (its tokens) and k, the class that its neighbours choose, for all words that ``neighbours`` counts."""
    classes = len(between)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("k", pa.int32())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words, keys, counts = batch.column(0), batch.column(1), batch.column(2)
                lists = keys.flatten()  # of a word's rows, and of these the keys
                owner = np.repeat(np.repeat(np.arange(len(words)), keys.value_lengths().to_numpy()), lists.value_lengths().to_numpy())
                n = np.bincount(owner * (2 * classes + 1) + lists.flatten().to_numpy(), counts.flatten().flatten().to_numpy(), len(words) * (2 * classes + 1)).reshape(len(words), -1)
                own = unit_class[np.array([units.of(w) for w in words.to_pylist()], np.int64)]
                left, right, self_pairs = n[:, :classes], n[:, classes:-1], n[:, -1]
                found = best_classes(own, left, right, self_pairs, between)
                c = (left.sum(axis=1) + self_pairs).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(found.astype(np.int32))], schema=schema)

    # the tasks have counted before: a word has few rows, each of at most 2 * classes + 1 keys
    gathered = neighbours.repartition("word").groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("x")).select("word", "x.key", "x.n")
    return gathered.mapInArrow(choose, "word binary, c long, k int")


def exchange(pairs: DataFrame, units: Units, classes: int, rounds: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of every unit and the class bigram counts, by exchange clustering; class 0 is the end's alone.

    The neighbours of each unit are gathered once, a row of bounded size. In each round, tasks find the best class for
    each of their units against the counts before the round; of those that gain, a drawn part moves, since moves made
    together can undo each other. The assignment of the highest likelihood of all rounds is kept.
    """
    size = len(units)
    sides = pairs.select("u", F.struct("v", "n").alias("x"), F.lit(1).alias("side")).unionByName(pairs.select(F.col("v").alias("u"), F.struct(F.col("u").alias("v"), "n").alias("x"), F.lit(0).alias("side")))
    rows = sides.groupBy("u").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("x")))).alias("after"), F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("x")))).alias("before")
    )
    flat = rows.select("u", *[F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("after", "before") for f in ("v", "n")])
    flat = stored(flat.repartition(max(8, size // 400), "u"), folder, "neighbours")
    assigned = np.array([0] + [1 + (k % (classes - 1)) for k in range(size - 1)])
    between = np.zeros((classes, classes))

    def votes(frames, assigned: np.ndarray, between: np.ndarray, move: bool):
        for frame in frames:
            out = []
            for u, after_v, after_n, before_v, before_n in frame.itertuples(index=False):
                own = assigned[u]
                right = np.bincount(assigned[after_v], after_n, classes) if len(after_v) else np.zeros(classes)
                left = np.bincount(assigned[before_v], before_n, classes) if len(before_v) else np.zeros(classes)
                pairs_with_self = float(np.asarray(after_n)[np.asarray(after_v) == u].sum()) if len(after_v) else 0.0
                new, gain = int(own), 0.0
                if move and u:
                    r, l = right.copy(), left.copy()  # noqa: E741
                    r[own] -= pairs_with_self
                    l[own] -= pairs_with_self
                    new, gain = best_class(int(own), l, r, pairs_with_self, between)
                out.append((int(u), new, gain, right.tolist()))
            yield pd.DataFrame(out, columns=["u", "new", "gain", "followers"])

    def ask(assigned: np.ndarray, between: np.ndarray, move: bool):
        return flat.mapInPandas(lambda frames: votes(frames, assigned, between, move), "u int, new int, gain double, followers array<double>").toPandas()  # one row per unit

    def bigrams(answer, assigned: np.ndarray) -> np.ndarray:
        counts = np.zeros((classes, classes))
        for u, followers in zip(answer["u"], answer["followers"]):
            counts[assigned[u]] += followers
        return counts

    best = None
    for turn in range(rounds + 1):
        if turn == 0:
            between = bigrams(ask(assigned, between, False), assigned)
        answer = ask(assigned, between, True)
        between_now = bigrams(answer, assigned)
        likelihood = _xlogx(between_now).sum() - _xlogx(between_now.sum(axis=0)).sum() - _xlogx(between_now.sum(axis=1)).sum()
        if best is None or likelihood > best[0]:
            best = (likelihood, assigned.copy(), between_now)
        chosen = np.random.default_rng(turn).random(size) < MOVING
        moving = answer[(answer["gain"] > 1e-9) & (answer["new"] != 0) & chosen[answer["u"]]]
        if turn == rounds or not (answer["gain"] > 1e-9).any():
            break
        assigned = assigned.copy()
        assigned[moving["u"].to_numpy()] = moving["new"].to_numpy()
        between = bigrams(ask(assigned, between, False), assigned)
    return best[1], best[2]


@dataclass
class Vocabulary:
    """``counts`` has word, c and the class k of every training word; ``listed`` are those whose logarithms of counts and classes tasks
    hold. The class of an unseen word is that of its unit in the core."""

    core: Units
    core_class: np.ndarray
    classes: int
    listed: list[bytes]
    listed_class: np.ndarray
    log_count: np.ndarray
    least: int
    counts: DataFrame
    total: int
    types: int


@dataclass
class Model:
    """``units`` are the core's and the further words that the driver holds, ``unit_class`` their classes."""

    units: Units
    unit_class: np.ndarray
    transitions: np.ndarray
    share: np.ndarray
    counts: DataFrame
    total: int
    types: int


def learn(train: DataFrame, folder: str, words: int = 2_000, endings: int = 500, listed: int = 200_000, classes: int = 64, rounds: int = 16) -> Vocabulary:
    """Classes of all words of ``train``. ``words`` and ``endings`` bound the core's units, ``listed`` the words whose counts
    and classes the tasks hold; the driver gets those and the class counts."""
    spark = train.sparkSession
    counts = stored(count_words(train), folder, "words")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()  # at most 1,024 rows
    least = int(min([r.c for r, held in zip(steps, np.cumsum([r.n for r in steps])) if held <= listed], default=total + 1))
    frequent = counts.where((F.octet_length("word") > 0) & (F.col("c") >= least)).collect()  # at most ``listed`` rows
    top = sorted(((bytes(r.word), r.c) for r in frequent), key=lambda t: (-t[1], t[0]))
    ends = counts.where(F.octet_length("word") > 0).withColumn("e", F.expr(f"substring(word, -{ENDING}, {ENDING})")).groupBy("e").agg(F.sum("c").alias("c"))
    common = [bytes(r.e) for r in ends.orderBy(F.desc("c"), "e").limit(endings).collect()]
    core = Units([w for w, _ in top[:words]], common)
    pairs = stored(count_pairs(train, core), folder, "pairs")
    core_class, between = exchange(pairs, core, classes, rounds, folder)
    ends_count = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known = [(w, int(c), int(core_class[core.word[w]])) for w, c in [(END, ends_count), *top[:words]] if c]
    further = choose_classes(count_neighbours(train, core, core_class, classes), core, core_class, between)
    classed = stored(further.unionByName(spark.createDataFrame(known, "word binary, c long, k int")), folder, "classed")
    class_of = {bytes(r.word): r.k for r in classed.where(F.col("c") >= least).select("word", "k").collect()}  # at most ``listed`` rows and the end
    names = [END, *[w for w, _ in top]]
    log_count = np.log10(np.array([ends_count, *[c for _, c in top]]) + EMISSION)
    return Vocabulary(core, core_class, classes, names, np.array([0, *[class_of[w] for w in names[1:]]]), log_count, least, classed, int(total), int(types))


def lay(docs: DataFrame, vocabulary: Vocabulary, folder: str, name: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, logs (the sum of its tokens' logarithms of counts) and ks, the class of
    each token in a fixed number of bytes.

    Tasks look up the listed words, and hand on the other words with their places; those are joined with the counts and classes. No frequent word takes part in that join.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("ks", pa.binary())])
    core, core_class, log_count, names, listed_class = vocabulary.core, vocabulary.core_class, vocabulary.log_count, vocabulary.listed, vocabulary.listed_class
    classes, narrow = vocabulary.classes, np.min_scalar_type(vocabulary.classes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        count_log = np.concatenate([log_count, np.zeros(classes)])
        class_of = np.concatenate([listed_class, np.arange(classes)])

        class Place(dict):
            def __missing__(self, word: bytes) -> int:  # a word that is not listed stands for the class of its ending, until it is joined
                return len(names) + core_class[core.of(word)]

        place = Place({w: k for k, w in enumerate(names)})
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        rare: list[bytes] = []
        places: list[np.ndarray] = []
        size = 0

        def batches_of() -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows_, counts = columns[0], [len(p) for p in places]
            for own in (dict(zip(("row", "doc_id", "n", "known", "logs", "ks"), columns)), {"row": np.repeat(np.array(rows_, np.int64), counts), "word": rare, "place": np.concatenate([np.zeros(0, np.int32), *places])}):
                yield pa.RecordBatch.from_arrays([pa.array(own[t.name], t.type) if t.name in own else pa.nulls(len(own["row"]), t.type) for t in schema], schema=schema)
            for c in (*columns, rare, places):
                c.clear()
            size = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py())
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                others = np.flatnonzero(at >= len(names))
                rare.extend(map(words.__getitem__, others.tolist()))
                places.append(others.astype(np.int32))
                for c, value in zip(columns, (row, doc_id, len(words), len(words) - len(others), float(count_log[at].sum()), class_of[at].astype(narrow).tobytes())):
                    c.append(value)
                row += 1
                size += len(words)
                if size > 500_000:
                    yield from batches_of()
        yield from batches_of()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, found = batch.column("ks").to_pylist(), batch.column("found")
            begins = np.cumsum([0, *[len(x) // narrow.itemsize for x in ks]])
            k, x = np.frombuffer(b"".join(ks), narrow).copy(), found.flatten()
            owner = np.repeat(np.arange(len(ks)), found.value_lengths().fill_null(0).to_numpy())
            k[begins[owner] + x.field("place").to_numpy()] = x.field("k").to_numpy()
            filled = [k[a:b].tobytes() for a, b in zip(begins, begins[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")] + [pa.array(filled, pa.binary())], names=["doc_id", "n_tokens", "n_known", "logs", "ks"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = stored(whole.mapInArrow(partial, "row long, doc_id long, word binary, place int, n long, known long, logs double, ks binary"), folder, f"{name}-parts")
    rare = parts.where("word IS NOT NULL").select("row", "word", "place").join(vocabulary.counts.where(F.col("c") < vocabulary.least), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(EMISSION))).alias("rare_logs"),
        F.count("c").alias("rare_known"),
        F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "place"))).alias("found"),  # no more than the document's tokens
    )
    out = parts.where("word IS NULL").join(rare, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("logs"),
        "ks",
        "found",
    )
    return stored(out.mapInArrow(fill, "doc_id long, n_tokens long, n_known long, logs double, ks binary"), folder, name)


def weigh(vocabulary: Vocabulary, laid: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The logarithms of transitions, and of each class's mass of tokens and types, from the classes of all training tokens."""
    classes, narrow = vocabulary.classes, np.min_scalar_type(vocabulary.classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for ks in batch.column(0).to_pylist():
                k = np.frombuffer(ks, narrow).astype(np.int64)
                found += np.bincount(np.concatenate([[0], k[:-1]]) * classes + k, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(found)], names=["pair", "n"])

    between = np.zeros(classes * classes)
    for pair, n in laid.select("ks").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():  # one row per pair of classes
        between[pair] = n
    between = between.reshape(classes, classes)
    types_of = np.zeros(classes)
    for k, n in vocabulary.counts.groupBy("k").agg(F.count(F.lit(1))).collect():  # one row per class
        types_of[k] = n
    tokens_of = between.sum(axis=0)
    prior = (tokens_of + 0.5) / (tokens_of.sum() + 0.5 * classes)
    transitions = (between + TRANSITION * prior[None, :]) / (between.sum(axis=1, keepdims=True) + TRANSITION)
    return np.log10(transitions), np.log10(tokens_of + EMISSION * (types_of + 1))


def fit(train: DataFrame, folder: str, **options) -> Model:
    """The model of all rows of ``train``, with the classes of the listed words, or of all words if there are no more than HELD."""
    v = learn(train, folder, **options)
    transitions, share = weigh(v, lay(train, v, folder, "laid"))
    held = v.counts if v.types <= HELD else v.counts.where(F.col("c") >= v.least)
    further = {bytes(r.word): r.k for r in held.select("word", "k").collect() if bytes(r.word) not in v.core.word}
    units = Units(v.core.words, v.core.endings)
    units.word |= {w: len(units) + i for i, w in enumerate(further)}
    return Model(units, np.concatenate([v.core_class, np.array(list(further.values()), np.int64)]), transitions, share, v.counts, v.total, v.types)


def score(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out and scores all. A null text is empty: its end alone is scored. ``score``
    is the base-10 logarithm of the whole text's probability under the class model: each class splits its mass between
    its training words, by count plus EMISSION, and one unknown word of weight EMISSION. ``base_score`` is that of the
    unigram model over the same tokens. Words of equal count are taken in the order of their bytes, and of classes that gain alike
    the first. Texts are scored whole, however long; one text's tokens must fit in a task's memory. Repeated rows are scored
    alike; other columns are not read; an empty table gives no row.
    """
    folder = folder or shared_dir(docs.sparkSession)
    vocabulary = learn(docs.where(~held_out(F.col("doc_id"))), folder, **options)
    laid = lay(docs, vocabulary, folder, "laid")
    transitions, share = weigh(vocabulary, laid.where(~held_out(F.col("doc_id"))))
    narrow = np.min_scalar_type(vocabulary.classes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = []
            for ks in batch.column("ks").to_pylist():
                k = np.frombuffer(ks, narrow)
                others.append(float(transitions[np.concatenate([[0], k[:-1]]).astype(np.int64), k].sum() - share[k].sum()))
            kept = [batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(others, pa.float64())], names=["doc_id", "n_tokens", "n_known", "logs", "others"])

    whole_mass = float(np.log10(vocabulary.total + BASE * (vocabulary.types + 1)))
    return laid.mapInArrow(judge, "doc_id long, n_tokens long, n_known long, logs double, others double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(whole_mass)).alias("base_score"),
        (F.col("logs") + F.col("others")).alias("score"),
    )
