"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each text gives a vector of transformed statistics. Per stratum (language and source) the mean and
covariance of the H share of rows with the least determinant of the covariance are sought over all
rows by concentration steps from several starts: a step takes every row's Mahalanobis distance
under each start's last estimate, sums counts, values and products in narrow classes of distance
(tasks combine them before the exchange, so a hot stratum costs no more than any other), and takes
the classes up to the H share, the last one in part. Steps go on until no determinant falls by more
than SETTLED, and of a stratum's starts the one with the least determinant is taken. FLOORS are
added to the variances (the determinant is that of the regularised covariance), so that statistics
which hardly vary in most texts don't turn every small difference into an outlier.

A row is rejected if its squared distance is beyond CUTOFF times the chi-square quantile QUANTILE
of as many degrees as there are statistics. For normal data 1 would do; text statistics have longer
tails, which the factor leaves room for.

Strata with fewer than MIN_ROWS rows are pooled with the other small ones of their language, and
where those pools are small too, with each other.

Defined results: a null text has no words; a text that fails the base rules isn't kept and takes
no part in the estimates; null languages and sources are strata like any other; a null id stays
null; every row of the input gives one row; texts of any length are read whole; other columns of
the input are left alone.
"""

from __future__ import annotations

from functools import reduce
from math import exp, factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import checkpointed, gathered, map_batches, read_table

MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Share of rows that the estimate rests on, the most steps, and the fall of the logarithm of a
#: determinant at which a start stands still.
H, STEPS, SETTLED = 0.75, 30, 1e-3
MIN_ROWS = 60
#: Quantile of the chi-square distribution, and how many times as far a rejected text is.
QUANTILE, CUTOFF = 0.99, 7.14
#: Classes of distance to each doubling.
CLASSES = 12
#: Statistics, and the least standard deviation that each is taken to have.
FLOORS = {
    "word_length": 0.08,  # log of mean code points of a word
    "symbols": 0.05,  # square root of symbols a word
    "dup_lines": 0.10,  # square root of the share of repeated lines
    "repeats": 0.10,  # square root of the share of words in repeated windows
    "capitals": 0.06,  # square root of the share of A-Z among bytes
    "variety": 0.20,  # log of distinct words over the square root of words
}
NAMES = list(FLOORS)
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    covered = bytearray(len(words))
    for k, w in enumerate(windows):
        if w in again:
            covered[k : k + 3] = b"\1\1\1"
    return sum(covered)


def statistics(text: str | None) -> tuple:
    """Base counts and transformed statistics of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n
    values = [0.0] * len(NAMES)
    if n:
        values = [
            log(word_chars / n),
            (n_symbols / n) ** 0.5,
            (n_dup_lines / len(lines)) ** 0.5,
            (n_repeat / n) ** 0.5,
            (len(data.translate(None, NOT_CAPITALS)) / word_chars) ** 0.5,
            log(len(set(words)) / n**0.75),
        ]
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, *values


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def described(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def setup():
        def kernel(ids, texts, langs, sources):
            return [ids, langs, sources, *zip(*map(statistics, texts))]

        return kernel

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, _lang STRING, _source STRING, {', '.join(f'{c} LONG' for c in COUNTS)}, base_failed BOOLEAN, {', '.join(f'_{c} DOUBLE' for c in NAMES)}"
    return map_batches(docs, [id_col, text_col, F.col(lang_col).cast("string"), F.col(source_col).cast("string")], schema, setup)


def with_stratum(rows: DataFrame) -> DataFrame:
    """rows with _own, the stratum whose estimate they take part in and are judged by."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit("\x00")) for c in ("_lang", "_source")})
    counts = rows.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("_n"))
    pooled = counts.groupBy("_lang").agg(F.sum(F.when(F.col("_n") < MIN_ROWS, F.col("_n"))).alias("_m"))
    own = F.when(F.col("_n") >= MIN_ROWS, F.concat_ws("\x1f", "_lang", "_source")).when(F.col("_m") >= MIN_ROWS, F.col("_lang")).otherwise(F.lit(""))
    return rows.join(gathered(counts.join(pooled, "_lang").select("_lang", "_source", own.alias("_own"))), ["_lang", "_source"])


def distance(center: str = "_mean", inverse: str = "_inverse") -> Column:
    """Squared Mahalanobis distance of a row to its stratum's estimate."""
    p = len(NAMES)
    off = [F.col(f"_{c}") - F.col(center)[k] for k, c in enumerate(NAMES)]
    terms = [off[a] * off[b] * F.col(inverse)[a * p + b] * (1 if a == b else 2) for a in range(p) for b in range(a, p)]
    return reduce(lambda x, y: x + y, terms)


def next_estimate(classes: pd.DataFrame, h: float = H) -> pd.DataFrame:
    """Mean, inverse covariance and log determinant of the h share of closest rows of one stratum
    under one start."""
    p = len(NAMES)
    classes = classes.sort_values("_class")
    n = classes["_n"].to_numpy(float)
    before = np.concatenate([[0.0], np.cumsum(n)[:-1]])
    share = np.clip((h * n.sum() - before) / n, 0, 1)
    weight = (n * share).sum()
    mean = np.array([(classes[f"_s{a}"] * share).sum() for a in range(p)]) / weight
    cov = np.empty((p, p))
    for a in range(p):
        for b in range(a, p):
            cov[a, b] = cov[b, a] = (classes[f"_p{a}_{b}"] * share).sum() / weight - mean[a] * mean[b]
    # the closest rows vary less than all do; for normal data, by this factor
    cov = (cov + cov.T) / 2 * consistency(h, p) + np.diag([f * f for f in FLOORS.values()])
    own, start = classes["_own"].iloc[0], classes["_start"].iloc[0]
    return pd.DataFrame({"_own": [own], "_start": [start], "_mean": [mean.tolist()], "_inverse": [np.linalg.inv(cov).reshape(-1).tolist()], "_det": [float(np.linalg.slogdet(cov)[1])], "_was": [float(classes["_was"].iloc[0])]})


def chi_square(x: float, k: int) -> float:
    """Distribution function for an even number k of degrees."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))


def chi_square_quantile(q: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < q else (low, mid)
    return low


def consistency(h: float, p: int) -> float:
    """h over the chi-square distribution with p + 2 degrees at the h quantile of that with p."""
    p += p % 2
    return h / chi_square(chi_square_quantile(h, p), p + 2)


ESTIMATE = "_own STRING, _start INT, _mean ARRAY<DOUBLE>, _inverse ARRAY<DOUBLE>, _det DOUBLE, _was DOUBLE"


def starts(good: DataFrame) -> DataFrame:
    """First estimates of each stratum: medians and quartile ranges; means and variances; medians
    and the ranges of the middle tenths."""
    p = len(NAMES)
    quantiles = [F.percentile_approx(f"_{c}", [0.25, 0.45, 0.5, 0.55, 0.75], 1000).alias(f"_q{k}") for k, c in enumerate(NAMES)]
    moments = [f(f"_{c}").alias(f"_{x}{k}") for k, c in enumerate(NAMES) for x, f in (("m", F.avg), ("v", F.var_pop))]
    of = good.groupBy("_own").agg(*quantiles, *moments)
    floor = [F.lit(f * f) for f in FLOORS.values()]
    at = lambda k, i: F.col(f"_q{k}")[i]
    median, mean = F.array(*(at(k, 2) for k in range(p))), F.array(*(F.col(f"_m{k}") for k in range(p)))
    spreads = [
        (median, [F.pow((at(k, 4) - at(k, 0)) / 1.349, 2) for k in range(p)]),
        (mean, [F.col(f"_v{k}") for k in range(p)]),
        (median, [F.pow((at(k, 3) - at(k, 1)) / 0.2513, 2) for k in range(p)]),
    ]
    inverse = lambda spread: F.array(*(1 / (spread[a] + floor[a]) if a == b else F.lit(0.0) for a in range(p) for b in range(p)))
    all_of = F.array(*(F.struct(F.lit(k).alias("_start"), m.alias("_mean"), inverse(v).alias("_inverse")) for k, (m, v) in enumerate(spreads)))
    return of.select("_own", F.explode(all_of).alias("_s")).select("_own", "_s.*", F.lit(float("inf")).alias("_det"))


def estimates(rows: DataFrame, h: float = H, steps: int = STEPS) -> DataFrame:
    """(_own, _mean, _inverse, _det) by stratum, over all rows that pass the base rules."""
    p = len(NAMES)
    good = rows.where(~F.col("base_failed")).select("_own", *(f"_{c}" for c in NAMES))
    moving, settled = gathered(starts(good)), []
    sums = [F.count("*").alias("_n"), *(F.sum(f"_{c}").alias(f"_s{a}") for a, c in enumerate(NAMES))]
    sums += [F.sum(F.col(f"_{NAMES[a]}") * F.col(f"_{NAMES[b]}")).alias(f"_p{a}_{b}") for a in range(p) for b in range(a, p)]
    falls = F.col("_det") < F.col("_was") - SETTLED
    for _ in range(steps):
        near = good.join(moving.withColumnRenamed("_det", "_was"), "_own").withColumn("_class", F.floor(CLASSES * F.log2(distance() + 1e-6)).cast("int"))
        classes = near.groupBy("_own", "_start", "_class").agg(*sums, F.first("_was").alias("_was"))
        new = gathered(classes.groupBy("_own", "_start").applyInPandas(lambda classes: next_estimate(classes, h), ESTIMATE))
        settled.append(new.where(~falls).drop("_was"))
        moving = new.where(falls).drop("_was")
        if moving.isEmpty():
            break
    found = reduce(DataFrame.unionByName, [*settled, moving])
    return found.groupBy("_own").agg(F.min_by(F.struct("_mean", "_inverse", "_det"), F.struct("_det", "_start")).alias("_e")).select("_own", "_e.*")


def judged(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """_id, the base counts, base_failed, distance and kept of every row of docs."""
    rows = with_stratum(checkpointed(described(docs, id_col, text_col, lang_col, source_col)))
    far = rows.join(gathered(estimates(rows)), "_own", "left").withColumn("distance", distance())
    limit = cutoff * chi_square_quantile(QUANTILE, len(NAMES))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return far.select("_id", *COUNTS, "base_failed", kept.alias("kept"), F.round("distance", 3).alias("distance"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")
