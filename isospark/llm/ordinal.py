"""Operator 1, quality classifier: ordinal cumulative-link regression on hashed text.

Ratings 0 < 1 < ... < K-1 follow ``P(y <= k) = sigmoid(theta_k - w.x)``: one weight vector for
all grades and ordered thresholds.  A text's features are the presence of its words (hashed)
and rates of characters and repeats per word.  ``fit`` takes a bounded sample of the rated rows,
keeps the buckets that tell grades apart, and minimises the penalised negative log-likelihood by
L-BFGS; every gradient is a sum over partitions, and the driver holds the weights alone.
``score`` gives expected grade and tail probability of every row in one pass without a shuffle.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name
from .decontaminate import words

#: Rated rows used for fitting at most, chosen by a hash of the id.
FIT_ROWS = 16_000
FIT_PARTITIONS = 8
#: A bucket is used if so many fitting rows have it and its score against the grade is so many deviations.
MIN_ROWS, MIN_SCORE = 8, 4.0
PENALTY, STEPS = 0.5, 200
#: A fit is at rest when a step gains less than this share of the loss.
GAIN = 1e-6
#: A row is kept if its probability of the top grade reaches this.
KEEP = 0.5
#: Bytes of the beginnings and endings of words that are hashed beside the words.
AFFIX = 5

#: Buckets above the 32-bit hashes of words: rates of single characters, capitals, digits and repeats.
_STYLE = 1 << 32
_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def features(b: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (each once) and values of a UTF-8 text."""
    w = words(b)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0)
    once = set(w)
    found = {zlib.crc32(x) for x in once}
    found.update([zlib.crc32(x, 1) for x in {x[:AFFIX] for x in once}])
    found.update([zlib.crc32(x, 2) for x in {x[-AFFIX:] for x in once}])
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=128)
    same = sum(map(bytes.__eq__, w, w[1:]))
    rates = np.r_[count[_PUNCTUATION], count[65:91].sum(), count[48:58].sum(), same] * (4.0 / len(w))
    style = np.flatnonzero(rates)
    return np.r_[np.fromiter(found, np.int64, len(found)), _STYLE + style], np.r_[np.ones(len(found)), np.minimum(rates[style], 4.0)]


@dataclass
class Model:
    """Buckets in use (ascending), their weights, and thresholds, ascending; whether the fit came to rest in its steps."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    converged: bool = True


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def loss_and_gradient(y: np.ndarray, start: np.ndarray, idx: np.ndarray, val: np.ndarray, w: np.ndarray, theta: np.ndarray):
    """Negative log-likelihood of rows ``idx[start[i]:start[i + 1]]`` and its gradients."""
    row = np.repeat(np.arange(len(y)), np.diff(start))
    s = np.bincount(row, weights=val * w[idx], minlength=len(y))
    bound = np.r_[-np.inf, theta, np.inf]
    upper, lower = _sigmoid(bound[y + 1] - s), _sigmoid(bound[y] - s)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    g = np.bincount(idx, weights=val * (du - dl)[row], minlength=len(w))
    k = len(theta)
    gt = np.bincount(y, weights=-du, minlength=k + 1)[:k] + np.bincount(y, weights=dl, minlength=k + 1)[1 : k + 1]
    return float(-np.log(p).sum()), g, gt


#: Texts whose features are held at once.
_SLICE = 256


def _feature_rows(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            rows = [features(b) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield _sparse_batch(batch.column(0), np.cumsum([0, *(len(r[0]) for r in rows)]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))


def _sparse_batch(grade: pa.Array, start: np.ndarray, idx: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(start, pa.int32())
    return pa.RecordBatch.from_arrays([grade, pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(val, pa.float64()))], names=["grade", "idx", "val"])


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, buckets and values of a batch of sparse rows."""
    lists = batch.column(1)
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _narrowed(state):
    """Rows reduced to the buckets in use, by their places."""

    def run(batches):
        for batch in batches:
            start, idx, val = _parts(batch)
            at, known = _placed(state.value, idx)
            yield _sparse_batch(batch.column(0), np.r_[0, np.cumsum(known)][start], at[known], val[known])

    return run


def _placed(buckets: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``idx`` in ``buckets`` and which of them are there."""
    if not len(buckets):
        return np.zeros(len(idx), np.int64), np.zeros(len(idx), bool)
    at = np.minimum(np.searchsorted(buckets, idx), len(buckets) - 1)
    return at, buckets[at] == idx


def _gradient(state):
    def run(batches):
        w, theta = state.value
        total = None
        for batch in batches:
            got = loss_and_gradient(batch.column(0).to_numpy(), *_parts(batch), w, theta)
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], names=["loss", "g", "gt"])

    return run


def _screened(rows: DataFrame, min_rows: int, min_score: float) -> np.ndarray:
    """Buckets that enough rows have and that tell grades apart, and all style buckets.

    The score is the correlation with the grade times the root of the row count; at four
    deviations chance lets through about one bucket in sixteen thousand.
    """
    m, sd = rows.agg(F.avg("grade"), F.stddev_pop("grade")).first()
    if not sd:
        return np.zeros(0, np.int64)
    x = rows.select("grade", F.explode(F.arrays_zip("idx", "val")).alias("f"))
    z = F.abs(F.sum((F.col("grade") - m) * F.col("f.val"))) / (F.sqrt(F.sum(F.col("f.val") * F.col("f.val"))) * sd)
    told = x.groupBy(F.col("f.idx").alias("b")).agg(F.count("*").alias("n"), z.alias("z")).where((F.col("n") >= min_rows) & ((F.col("z") >= min_score) | (F.col("b") >= _STYLE)))
    return np.array(sorted(r.b for r in told.select("b").collect()), np.int64)


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS, min_rows: int = MIN_ROWS, min_score: float = MIN_SCORE, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The model of ``ratings(id_col, grade_col)`` over the texts of ``docs``.

    At most ``fit_rows`` rated rows are used, those first by a hash of the id, and of several rows of
    ``docs`` with a rated id one text, that with the least hash; an id with two ratings counts with
    each.  Ratings that are null or outside ``0..grades-1``, and rows without a partner, are left out;
    without any, all weights are zero and thresholds symmetric, so scoring still works.  A fit that
    has not come to rest after ``steps`` steps is used as it is, with a warning and ``converged`` false.
    """
    spark = docs.sparkSession
    rated = (
        ratings.where(F.col(grade_col).between(0, grades - 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col), F.col(grade_col).cast("int").alias("grade"))
        .orderBy(F.xxhash64(F.col(id_col)), id_col, "grade")
        .limit(fit_rows)
    )
    # Broadcast: ``limit`` bounds the side.
    found = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(rated), id_col)
    rows = found.groupBy(id_col, "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("grade", "least.text")
    sparse = "grade int, idx array<long>, val array<double>"
    wide = cut(rows.repartition(FIT_PARTITIONS).mapInArrow(_feature_rows, sparse))
    common = _screened(wide, min_rows, min_score)
    rows = cut(wide.mapInArrow(_narrowed(spark.sparkContext.broadcast(common)), sparse))
    n, k = max(rows.count(), 1), grades - 1

    def objective(v: np.ndarray):
        # Thresholds are the first one and positive gaps, so they stay in order.
        w, gaps = v[: len(common)], np.exp(v[len(common) + 1 :])
        theta = v[len(common)] + np.r_[0.0, np.cumsum(gaps)]
        state = spark.sparkContext.broadcast((w, theta))
        parts = rows.mapInArrow(_gradient(state), "loss double, g binary, gt binary").collect()
        state.destroy()
        loss = sum(p.loss for p in parts)
        g = sum((np.frombuffer(p.g) for p in parts), np.zeros(len(common)))
        gt = sum((np.frombuffer(p.gt) for p in parts), np.zeros(k))
        tail = np.cumsum(gt[::-1])[::-1]
        return (loss + penalty * 0.5 * (w @ w)) / n, np.r_[g + penalty * w, tail[0], tail[1:] * gaps] / n

    start = np.r_[np.zeros(len(common)), -0.5 * (k - 1), np.zeros(k - 1)]
    best, rested = _lbfgs(objective, start, steps)
    if not rested:
        warnings.warn(f"the fit has not come to rest in {steps} steps", stacklevel=2)
    return Model(common, best[: len(common)], best[len(common)] + np.r_[0.0, np.cumsum(np.exp(best[len(common) + 1 :]))], rested)


def _lbfgs(f, x: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, bool]:
    """The least point found, and whether the gradient or the gain of a step came to nearly nothing."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max(initial=0) < 1e-5:
            return x, True
        d, marks = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            marks.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(marks)):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        for _ in range(12):
            new = x + step * d
            v, h = f(new)
            if v <= value + 1e-4 * step * (g @ d):
                break
            step *= 0.4
        else:
            return x, True  # no step along a falling direction gains: at the limit of the arithmetic
        s, y = new - x, h - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        if value - v < GAIN * abs(value):
            return new, True
        x, value, g = new, v, h
    return x, False


def score(text: Column, model: Model, spark) -> Column:
    """A struct for a text column: ``expected_grade``, ``p_tail`` (probability of the top grade) and ``grade`` (the likeliest)."""
    state = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()), T.StructField("grade", T.IntegerType())]))
    def run(texts: pa.Array) -> pa.Array:
        m = state.value
        s = np.zeros(len(texts))
        for i, b in enumerate(texts.cast(pa.binary()).to_pylist()):
            idx, val = features(b)
            at, known = _placed(m.buckets, idx)
            s[i] = m.weights[at[known]] @ val[known]
        above = _sigmoid(s[:, None] - m.thresholds)
        p = -np.diff(np.c_[np.ones(len(s)), above, np.zeros(len(s))], axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, -1] if above.shape[1] else np.ones(len(s))), pa.array(p.argmax(1).astype(np.int32))], names=["expected_grade", "p_tail", "grade"])

    return run(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 poor, 1 sound but toxic, 2 sound."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def classify(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **options) -> DataFrame:
    """``(id_col, expected_grade, p_tail, grade, kept)``, one row per row of ``docs``.

    Null and empty texts have no features and are judged by the thresholds alone; very long ones are
    read whole, one at a time.  Of equally likely grades the lowest is given; a probability equal to
    ``keep`` is kept.  Null and repeated ids keep a row each; further columns are not read; an empty
    table gives none.
    """
    model = fit(docs, ratings, grades, id_col, text_col, **options)
    return docs.select(F.col(id_col), score(F.col(text_col), model, docs.sparkSession).alias("_s")).select(id_col, "_s.*", (F.col("_s.p_tail") >= keep).alias("kept"))


def keep_good(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps; texts and ids are treated as by ``classify``."""
    model = fit(docs, ratings, grades, id_col, text_col, **options)
    s = free_name(docs, "score")
    return docs.withColumn(s, score(F.col(text_col), model, docs.sparkSession)).where(F.col(f"{s}.p_tail") >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])
