"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram distribution over the pieces of a fixed public vocabulary. A word's probability under a
language is the sum, over all its segmentations into pieces, of the product of their probabilities; a forward pass over
the word's bytes computes that sum. A text's words are independent, so its log probability is a sum over words, and each
worker computes a word once, for all languages together.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import fresh, releasing

#: Weight of each piece of the vocabulary beside the counts.
SMOOTHING = 0.05
#: Words of up to so many bytes are computed together and remembered, so many at most; longer ones are computed each time.
LONGEST, REMEMBERED = 40, 200_000
#: Characters of text whose words are held at once.
CHUNK = 500_000
#: Labelled rows that the classifier is fitted on, in expectation: a sample by hash where there are more.
TRAIN_ROWS = 40_000

letters = re.compile(r"[^\W\d_]+").findall


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(tokenizer_path: str) -> tuple[dict[bytes, int], dict[bytes, int], int]:
    """Pieces inside a word, pieces that end a word, and the number of ids. All single bytes are among both."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = byte_letters()
    inner, final = {}, {}
    for piece, i in vocab.items():
        body, into = (piece[:-4], final) if piece.endswith("</w>") else (piece, inner)
        if body and all(c in to_byte for c in body):
            into[bytes(to_byte[c] for c in body)] = i
    return inner, final, max(vocab.values()) + 1


@dataclass
class Model:
    """``log_prior`` per language and ``probs``, one row per piece id with a last row of zeros, one column per language."""

    languages: list[str]
    log_prior: np.ndarray
    probs: np.ndarray


def words_of_text(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none where the text has no letter at all."""
    found = letters(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of doc_id as text is divisible by ``folds``; a null doc_id counts as the empty text, so as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(train: DataFrame, tokenizer_path: str) -> Model:
    """Learns from the rows of ``train`` with a non-null lang: the counts of the pieces that the tokenizer finds.

    Rows are counted in their partitions; per language and piece, one sum reaches the driver, which holds as many numbers
    as there are labels times ids of the vocabulary. A table without rows or labels gives a model without languages.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        words: dict[str, Counter] = defaultdict(Counter)
        pieces: Counter = Counter()

        def to_pieces() -> None:
            for lang, counted in words.items():
                listed = list(counted)
                for at in range(0, len(listed), 5_000):
                    part = listed[at : at + 5_000]
                    for word, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                        for i in e.ids:
                            pieces[lang, i] += counted[word]
            words.clear()

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                words[lang].update(words_of_text(text))
                if sum(map(len, words.values())) > REMEMBERED:
                    to_pieces()
        to_pieces()
        rows = [(lang, i, n) for (lang, i), n in pieces.items()]
        yield pd.DataFrame(rows, columns=["lang", "piece", "n"])

    rows = train.where(F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    known = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())  # one row per label
    languages, docs = [lang for lang, _ in known], np.array([n for _, n in known], float)
    size = vocabulary(tokenizer_path)[2]
    if not languages:
        return Model([], np.zeros(0), np.zeros((size + 1, 0)))
    counted = rows.mapInPandas(releasing(count), "lang string, piece int, n long")
    column, table = {lang: k for k, lang in enumerate(languages)}, np.zeros((size, len(languages)))
    for lang, piece, n in counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        table[piece, column[lang]] = n
    probs = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=0)
    return Model(languages, np.log(docs / docs.sum()), np.vstack([probs, np.zeros(len(languages))]))


class WordScores:
    """Log probabilities of words under all languages, remembered up to a bound."""

    def __init__(self, model: Model, tokenizer_path: str):
        self.probs, self.width = model.probs, len(model.languages)
        self.inner, self.final, self.none = vocabulary(tokenizer_path)
        self.reach = max(map(len, [*self.inner, *self.final]))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, self.width))

    def learn(self, words: set[str]) -> None:
        """Computes the short words among ``words`` that are not remembered yet."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        by_length: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for w in new:
            if len(b := w.encode()) <= LONGEST:
                by_length[len(b)].append((w, b))
        for n, group in ((n, g[at : at + 5_000]) for n, g in by_length.items() for at in range(0, len(g), 5_000)):
            at = len(self.index)
            while at + len(group) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(group)] = self.together([b for _, b in group], n)
            self.index.update((w, at + k) for k, (w, _) in enumerate(group))

    def together(self, words: list[bytes], n: int) -> np.ndarray:
        """The forward pass for words of n bytes each."""
        alpha = np.zeros((n + 1, len(words), self.width))
        alpha[0] = 1
        for j in range(1, n + 1):
            pieces = (self.final if j == n else self.inner).get
            for i in range(max(0, j - self.reach), j):
                ids = [pieces(w[i:j], self.none) for w in words]
                if any(x != self.none for x in ids):
                    alpha[j] += alpha[i] * self.probs[ids]
        return np.log(alpha[n])

    def long(self, word: str) -> np.ndarray:
        """The forward pass for one word of any length, scaled so that it can't underflow."""
        b = word.encode()
        recent, shift = [np.ones(self.width)], np.zeros(self.width)  # the last values, those of the nearest byte last
        for j in range(1, len(b) + 1):
            pieces = (self.final if j == len(b) else self.inner).get
            new = np.zeros(self.width)
            for back, value in enumerate(reversed(recent), 1):
                if (i := pieces(b[j - back : j], self.none)) != self.none:
                    new += value * self.probs[i]
            recent = [v / new for v in recent[1 - self.reach :]] + [np.ones(self.width)]
            shift += np.log(new)
        return shift

    def of(self, words: list[str]) -> np.ndarray:
        try:
            return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0)
        except KeyError:  # a long word
            known = [w for w in words if w in self.index]
            total = self.table[np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))].sum(axis=0)
            return total + sum(n * self.long(w) for w, n in Counter(w for w in words if w not in self.index).items())


def predict(text: Column, model: Model, tokenizer_path: str) -> Column:
    """A struct of lang_pred, score and n_words for each whole text.

    ``score`` is the language's posterior probability under the learned priors. A text that is null or has no letter,
    and any text where nothing was learned, gives ``und`` and 0. Equal posteriors go to the first language by name.
    """

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model, tokenizer_path)
        for series in texts:
            out: list[tuple[str, float, int]] = []
            held: list[list[str]] = []
            size = 0

            def flush() -> None:
                scores.learn(set().union(*held))
                for words in held:
                    if not words or not model.languages:
                        out.append(("und", 0.0, len(words)))
                        continue
                    log = scores.of(words) + model.log_prior
                    best = int(log.argmax())
                    out.append((model.languages[best], float(1 / np.exp(log - log[best]).sum()), len(words)))
                held.clear()

            for text in series:
                held.append(words_of_text(text))
                size += len(text or "")
                if size > CHUNK:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame(out, columns=["lang_pred", "score", "n_words"])

    @F.pandas_udf("lang_pred string, score double, n_words long")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from releasing(judge)(texts)

    return predicted(text)


def identify(docs: DataFrame, tokenizer_path: str, out: str = "_language", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds the struct ``out`` (lang_pred, score, n_words, held_out) to every row of ``docs``.

    Learns from the text and non-null lang of the rows that are not held out, of about ``train_rows`` of them where there
    are more, chosen by a hash of doc_id. Predicts from the text alone. All other columns stay as they are; repeated rows
    are predicted alike; an empty table stays empty.
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    if (rows := train.count()) > train_rows:
        train = train.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < round((1 << 20) * train_rows / rows))
    model = fit(train.select("lang", "text"), tokenizer_path)
    name = fresh(docs, "predicted")
    found = docs.withColumn(name, predict(F.col("text").cast("string"), model, tokenizer_path))
    return found.withColumn(out, F.struct(f"{name}.*", held_out(F.col("doc_id")).alias("held_out"))).drop(name)


def rejects(language: Column, least: float = 0.5) -> Column:
    """Whether a text has no language: undetermined, or no language takes at least ``least`` of the posterior."""
    return (language["lang_pred"] == "und") | (language["score"] < least)
