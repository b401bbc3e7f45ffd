"""Scalar functions on sequence strings, as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the bases; N stays N.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"

#: Letters that are counted at a time.
BLOCK = 1 << 18


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def to_rna(dna: Column, strand: Column) -> Column:
    """RNA of the strand: the reverse complement on ``-``, upper case, T written as U."""
    return F.translate(F.upper(F.when(strand == "-", reverse_complement(dna)).otherwise(dna)), "T", "U")


def gc_content(seq: Column) -> Column:
    """Share of G and C, 0 for an empty string."""
    n = F.length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(F.upper(seq), "GC", ""))) / n)


def window_bounds(start: Column, end: Column, size: int) -> Column:
    """Half-open window of odd ``size`` around the floor of the middle, as struct(start, end)."""
    middle, half = F.floor((start + end) / 2), size // 2
    return F.struct((middle - half).alias("start"), (middle + half + 1).alias("end"))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers in order; none where the string is shorter."""
    spots = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k)).otherwise(F.array().cast("array<int>"))
    # the letters are bound to a lambda: a substring would be sought from the string's start for each k-mer
    joined = lambda cs: F.transform(spots, lambda i: F.concat(*[F.get(cs, i + j) for j in range(k)]))
    return F.transform(F.array(F.split(seq, "")), joined)[0]


def occurrences(seq: Column, motif: Column | str) -> Column:
    """0-based starts of all overlapping occurrences."""
    motif = F.lit(motif) if isinstance(motif, str) else motif
    last = F.length(seq) - F.length(motif)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.length(motif)) == motif)).otherwise(F.array().cast("array<int>"))


def kmer_counts(seq: Column, k: int, alphabet: str = "ACGU", written: tuple[str, str] | None = None) -> Column:
    """Counts of all overlapping k-mers over ASCII letters, in the order of ``alphabet``; k-mers with other letters are skipped.
    Zeros for null. With ``written``, ASCII letters and those of the alphabet that they stand for, in order, all other letters are
    taken out before."""
    size = len(alphabet)
    code = np.full(256, size, np.uint8)  # further letters and the bytes of wider ones
    for letter, of in zip(*(written or (alphabet, alphabet))):
        code[ord(letter)] = alphabet.index(of)
    kept = (slice(size),) * k

    def count(texts: pa.Array) -> pa.Array:
        raw = texts.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        found = np.zeros((len(raw), size**k), np.int32)
        for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            letters = np.zeros(0, np.int64)
            for at in range(a, b, BLOCK):
                more = code[data[at : min(b, at + BLOCK)]]
                more = more[more < size] if written else more
                letters = np.concatenate([letters[max(0, len(letters) - k + 1) :], more])  # from the last k - 1 letters of before
                n = len(letters) - k + 1
                if n < 1:
                    continue
                number = sum(letters[j : j + n] * (size + 1) ** (k - 1 - j) for j in range(k))
                found[row] += np.bincount(number, minlength=(size + 1) ** k).reshape((size + 1,) * k)[kept].ravel().astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * size**k, pa.int32()), pa.array(found.ravel()))

    return F.arrow_udf(count, "array<int>")(seq)


def dinucleotide_counts(seq: Column, alphabet: str = "ACGU") -> Column:
    """Counts of the 16 overlapping pairs in alphabetical order; pairs with other letters are skipped."""
    return kmer_counts(seq, 2, alphabet)


def frequencies(counts: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    # each bound to a lambda, so that the counts are made and summed once
    shares = lambda c: F.transform(F.array(total(c)), lambda n: F.transform(c, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))[0]
    return F.transform(F.array(counts), shares)[0]


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def entropy(seq: Column, alphabet: str = "ACGU") -> Column:
    """Shannon entropy in bits of the base distribution."""
    letters = F.array(*map(F.lit, alphabet))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    share = lambda x, n: F.when(x > 0, x / n * F.log2(x / n)).otherwise(F.lit(0.0))
    # each bound to a lambda, so that the string is made and its letters are counted once
    counts = lambda s: F.transform(letters, lambda b: F.length(s) - F.length(F.replace(s, b, F.lit(""))))
    terms = lambda c: F.transform(F.array(total(c)), lambda n: F.aggregate(c, F.lit(0.0), lambda s, x: s - share(x, n)))[0]
    return F.transform(F.transform(F.array(seq), counts), terms)[0]


def minimal_period(seq: Column) -> Column:
    """The smallest shift under which the string agrees with itself, its length if there is none below."""
    n = F.length(seq)
    shifts = F.when(n >= 2, F.filter(F.sequence(F.lit(1), n - 1), lambda p: F.substring(seq, F.lit(1), n - p) == F.substring(seq, p + 1, n - p)))
    return F.coalesce(F.array_min(shifts), n)


def repeat_score(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n < 2, F.lit(0.0)).otherwise(1 - (minimal_period(seq) - 1) / (n - 1))


def runs(seq: Column) -> Column:
    """Lengths of the maximal runs of one letter."""
    return F.transform(F.regexp_extract_all(seq, F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda r: F.length(r))


def low_complexity(seq: Column, least: int = 3) -> Column:
    """Share of the string in runs of at least ``least``."""
    long = F.aggregate(runs(seq), F.lit(0), lambda s, r: s + F.when(r >= least, r).otherwise(F.lit(0)))
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(long / F.length(seq))


def longest_run(seq: Column) -> Column:
    return F.coalesce(F.array_max(runs(seq)), F.lit(0))


def one_hot(seq: Column, alphabet: str = "ACGU") -> Column:
    """One array of zeros and a one per letter; zeros alone for other letters."""
    return F.transform(F.split(seq, ""), lambda c: F.array(*[(c == b).cast("int") for b in alphabet]))


def genomic_position(start: Column, end: Column, strand: Column, index: Column, one_based: bool = True) -> Column:
    return F.when(strand == "+", start + index).otherwise(end - 1 - index) + int(one_based)


def normalise_chromosome(name: Column) -> Column:
    """``chr`` before the name, MT and M as chrM."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), F.lit("chrM")).otherwise(F.concat(F.lit("chr"), bare))


def attribute(field: Column, key: str) -> Column:
    """The value of ``key "value"`` in an annotation field, null when absent."""
    return F.nullif(F.regexp_extract(field, rf'(?:^|[ ;]){key} "([^"]*)"', 1), F.lit(""))


def info_field(info: Column, key: str) -> Column:
    """The value of ``key=value`` in a ;-separated field, null when absent."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def consequences(info: Column) -> Column:
    """Lower-cased terms of ``MC=SO:n|term,...``, empty ones dropped."""
    terms = F.transform(F.split(F.coalesce(info_field(info, "MC"), F.lit("")), ","), lambda x: F.lower(F.trim(F.element_at(F.split(x, r"\|"), -1))))
    return F.array_remove(terms, "")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -30.0, 30.0)))


def hanley_se(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Closed-form standard error of an AUROC."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg))


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal, which Spark lacks; p is clipped to [1e-6, 1 - 1e-6]."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return F.pandas_udf(lambda s: s.map(lambda x: inverse(min(max(x, 1e-6), 1 - 1e-6)), na_action="ignore").astype("float64"), "double")(p)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal."""
    import math

    return F.pandas_udf(lambda s: s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype("float64"), "double")(z)


def d_prime(auc: Column) -> Column:
    return F.lit(2.0**0.5) * normal_quantile(auc)


def standardise(x: Column, window) -> Column:
    """Population z-score over a window, 0 where the deviation is 0."""
    sd = F.stddev_pop(x).over(window)
    return F.when(sd == 0, F.lit(0.0)).otherwise((x - F.avg(x).over(window)) / sd)


def window_id(*columns: str) -> Column:
    return F.concat_ws(":", *columns)


def pair_suffix(identifier: Column) -> Column:
    return F.substring_index(identifier, "_", -1)
