"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view is a logistic regression over a few statistics: the content view's are counted in the
text, the metadata view has the language, the source and the stated size only. In every round each
view is fitted to the labelled rows and to the unlabelled rows of which the other view was
confident in the round before, with the other view's label; pseudo-labelled rows together weigh no
more than labelled ones. Some labelled rows are held back to calibrate each view and the
combination of both, which scores all documents.

Fitting is distributed: a Newton step needs the sums of the gradients and products of the
statistics, a few hundred numbers whatever the input, which tasks add up before the exchange. What
only labelled rows decide (the first round, calibration, combination) reads those alone; the other
rounds read the rest once a step. No row is sampled and no label reaches the driver.

Defined results: a null text counts as empty; null languages, sources and lengths are values of
their own; a null id has no label and stays null; of an id labelled several times the mean decides,
1 from a half up; null labels are none; without labels of both kinds no text is rejected (score
0.5); every row of the input gives one row; texts of any length are read whole; other columns are
left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import copy
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import checkpointed, map_batches, read_table, text_mark, without_rows

ROUNDS, NEWTON, RIDGE = 3, 5, 3.0
#: A view is confident from this calibrated probability on, of either class.
CONFIDENT = 0.98
#: A view's calibrated log-odds count up to this size, so that neither overrules the other alone.
VIEW_ODDS = 4.0
#: One labelled row in so many is held back for calibration.
HELD_BACK = 5
#: Score below which a document is rejected.
THRESHOLD = 0.5
#: Slots of the hashed source, language, and both together, and classes of the size's binary log.
SOURCE_SLOTS, LANG_SLOTS, BOTH_SLOTS, SIZES = 16, 8, 32, 20
SYMBOLS = b"#*$%&|<>@^~\\{}[]=_/"
KEEP = {name: bytes(b for b in range(256) if b not in chars) for name, chars in {"symbols": SYMBOLS, "capitals": bytes(range(65, 91)), "digits": b"0123456789", "points": b".,;:", "marks": b"!?"}.items()}


def content_view(text: str) -> list[float]:
    """What the text says: make-up of characters, repetition and variety of words, and its lines."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    share = {k: len(data.translate(None, keep)) / size for k, keep in KEEP.items()}
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    run = sum(a == b for a, b in zip(words, words[1:]))
    lines = data.split(b"\n")
    m, sizes = len(lines), [len(x) for x in lines]
    full = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines)
    return [
        min(3.0, sqrt(share["symbols"]) * 5),
        min(3.0, sqrt(share["capitals"]) * 3),
        sqrt(share["digits"]) * 3,
        sqrt(share["points"]) * 3,
        min(3.0, sqrt(share["marks"]) * 5),
        log(size / (n + 1)) - 1.6 if n else 0.0,
        len(counts) / (n + 1),
        sqrt(max(counts.values(), default=0) / (n + 1)) * 2,
        sqrt(run / (n + 1)) * 3,
        log(n + 1) / 6 - 1,
        log(m) / 3,
        log(sum(sizes) / m + 1) / 5 - 1,
        log(max(sizes) + 1) / 6 - 1,
        full / m,
        sum(s < 20 for s in sizes) / m,
        1 - len(set(lines)) / m,
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known of a page besides its text: the log of its stated size, and the numbers of its
    slots by source, language, both and size."""
    own, tongue, size = (source or "").encode("utf-8", "surrogatepass"), (lang or "").encode("utf-8", "surrogatepass"), max(0, n_chars or 0)
    slots = [zlib.crc32(own) % SOURCE_SLOTS, zlib.crc32(tongue) % LANG_SLOTS, zlib.crc32(own + b"\0" + tongue) % BOTH_SLOTS, min(SIZES - 1, size.bit_length())]
    return [log(size + 1) / 8 - 1, *slots]


SLOTS = (SOURCE_SLOTS, LANG_SLOTS, BOTH_SLOTS, SIZES)


def content_matrix(packed: list[bytes]) -> np.ndarray:
    """A row [1, statistics] for each packed content view."""
    x = np.frombuffer(b"".join(packed)).reshape(len(packed), N_CONTENT)
    return np.hstack([np.ones((len(x), 1)), x])


def metadata_matrix(packed: list[bytes]) -> np.ndarray:
    """A row [1, size, size squared, 0 or 1 for each slot] for each packed metadata view."""
    x = np.frombuffer(b"".join(packed)).reshape(len(packed), 1 + len(SLOTS))
    out = np.zeros((len(x), N_METADATA + 1))
    out[:, 0], out[:, 1], out[:, 2] = 1, x[:, 0], x[:, 0] ** 2
    at = 3
    for k, n in enumerate(SLOTS, 1):
        out[np.arange(len(x)), at + x[:, k].astype(int)] = 1
        at += n
    return out


N_CONTENT = len(content_view(""))
N_METADATA = 2 + sum(SLOTS)


def described(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    """_id, _mark (of rows without an id), _content and _metadata of every row, the last two as packed doubles."""

    def setup():
        def kernel(ids, marks, texts, langs, sources, sizes):
            pack = lambda v: np.array(v, float).tobytes()
            return [ids, marks, [pack(content_view(t or "")) for t in texts], [pack(metadata_view(*row)) for row in zip(langs, sources, sizes)]]

        return kernel

    kind = dict(docs.dtypes)[id_col]
    columns = [id_col, text_mark(id_col, text_col).alias("_mark"), text_col, F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(size_col).cast("long")]
    return map_batches(docs, columns, f"_id {kind}, _mark LONG, _content BINARY, _metadata BINARY", setup)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class View:
    """Weights of one view, and the slope and offset that calibrate its log-odds."""

    def __init__(self, size: int):
        self.weights, self.slope, self.offset = np.zeros(size + 1), 1.0, 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (x @ self.weights) + self.offset, -VIEW_ODDS, VIEW_ODDS)


def summed(rows: DataFrame, size: int, terms) -> np.ndarray:
    """Sum over all rows of terms(content, metadata, label, held back), arrays of `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                label = np.array([-1 if v is None else v for v in b.column(2).to_pylist()])
                total += terms(content_matrix(b.column(0).to_pylist()), metadata_matrix(b.column(1).to_pylist()), label, np.array(b.column(3).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

    parts = rows.select("_content", "_metadata", "_label", "_held").mapInArrow(run, "k INT, v DOUBLE")
    out = np.zeros(size)
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():  # `size` rows
        out[r["k"]] = r["v"]
    return out


def _newton(parts: list[tuple], width: int, start: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Logistic regression on parts (rows, inputs, most): inputs(content, metadata, label, held)
    gives x, target and weight; most, where given, is what the part may weigh in all."""
    beta = start.copy()
    penalty = np.full(width, ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        sums = np.zeros(width + width * width)
        for rows, inputs, most in parts:

            def terms(content, metadata, label, held, beta=beta, inputs=inputs):
                x, y, w = inputs(content, metadata, label, held)
                p = sigmoid(x @ beta)
                return np.concatenate([[w.sum()], x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).reshape(-1)])

            weight, *own = summed(rows, 1 + len(sums), terms)
            sums += np.array(own) * (1.0 if most is None else min(1.0, most / max(weight, 1.0)))
        gradient = sums[:width] + penalty * beta
        hessian = sums[width:].reshape(width, width) + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        beta = beta - move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    return beta


class Model:
    """Both views and the weights of their calibrated log-odds."""

    def __init__(self, content: View, metadata: View, combination: np.ndarray, informed: bool):
        self.content, self.metadata, self.combination, self.informed = content, metadata, combination, informed

    def probability(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if not self.informed:
            return np.full(len(content), 0.5)
        a, b, c = self.combination
        return sigmoid(a + b * self.content.odds(content) + c * self.metadata.odds(metadata))


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """rows: _content, _metadata, _label (1, 0 or null) and _held."""
    known, rest = checkpointed(rows.where("_label IS NOT NULL")), rows.where("_label IS NULL")
    n = summed(known, 4, lambda c, m, y, h: np.array([((y == 1) & ~h).sum(), ((y == 0) & ~h).sum(), ((y == 1) & h).sum(), ((y == 0) & h).sum()], float))
    views = [View(N_CONTENT), View(N_METADATA)]
    if not (n[0] and n[1]):
        return Model(*views, np.array([0.0, 1.0, 0.0]), False)
    high = log(CONFIDENT / (1 - CONFIDENT))  # 3.9, within VIEW_ODDS
    labelled, calibrate = n[0] + n[1], min(n[2], n[3]) >= 5
    for k in range(rounds):
        before = [copy(v) for v in views]
        for own, view in enumerate(views):

            def taught(content, metadata, label, held, own=own):
                return (content, metadata)[own], label.astype(float), (~held).astype(float)

            def guessed(content, metadata, label, held, own=own, other=before[1 - own]):
                z = other.odds((metadata, content)[own])
                return (content, metadata)[own], (z > 0).astype(float), (np.abs(z) >= high).astype(float)

            parts = [(known, taught, None)] + ([(rest, guessed, labelled)] if k else [])
            view.weights = _newton(parts, len(view.weights), view.weights, 2 if k else NEWTON, RIDGE)
            view.slope, view.offset = 1.0, 0.0
            if calibrate:

                def platt(content, metadata, label, held, view=view, own=own):
                    z = np.clip((content, metadata)[own] @ view.weights, -12, 12)
                    return np.stack([np.ones(len(z)), z], 1), label.astype(float), held.astype(float)

                offset, slope = _newton([(known, platt, None)], 2, np.array([0.0, 1.0]), 4, 1.0)
                view.slope, view.offset = float(max(slope, 0.05)), float(offset)

    def both(content, metadata, label, held):
        z = [v.odds(x) for v, x in zip(views, (content, metadata))]
        return np.stack([np.ones(len(label)), *z], 1), label.astype(float), (held | (not calibrate)).astype(float)

    combination = _newton([(known, both, None)], 3, np.array([0.0, 1.0, 0.0]), 5, 1.0)
    return Model(*views, combination, True)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str, label_col: str) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("_label"))
    held = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("held")), F.lit(HELD_BACK)) == 0
    rows = checkpointed(described(docs, id_col, text_col, lang_col, source_col, size_col).join(known, "_id", "left").withColumn("_held", F.coalesce(held, F.lit(False))))
    model = fitted(rows)

    def setup():
        def kernel(ids, marks, contents, metadatas):
            c, m = content_matrix(contents), metadata_matrix(metadatas)
            p = model.probability(c, m)
            return [ids, marks, p, sigmoid(model.content.odds(c)), sigmoid(model.metadata.odds(m))]

        return kernel

    kind = dict(rows.dtypes)["_id"]
    scores = map_batches(rows, ["_id", "_mark", "_content", "_metadata"], f"_id {kind}, _mark LONG, score DOUBLE, content_score DOUBLE, metadata_score DOUBLE", setup)
    return scores.withColumn("kept", F.col("score") >= THRESHOLD)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality") -> DataFrame:
    """_id, score, content_score, metadata_score and kept of every row of docs."""
    return _scored(docs, labels, id_col, text_col, lang_col, source_col, size_col, label_col).drop("_mark")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the classifier keeps. Rows with one id, and rows of one text without an
    id, go or stay by their lowest score."""
    scores = _scored(docs, labels, id_col, text_col, lang_col, source_col, size_col, label_col)
    return without_rows(docs, scores.where("NOT kept").withColumnRenamed("_id", id_col), id_col, text_col)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).withColumnRenamed("_id", "doc_id")
