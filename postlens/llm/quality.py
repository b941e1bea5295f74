"""Quality classifier: naive-Bayes support vectors on hashed n-gram indicators.

Indicators: word 1- and 2-grams, 1- to 4-grams of the sequence of character
classes, and how often a class gram or a repeated word occurs (by powers of
two). Each is scaled by its class log-count ratio, a linear hinge-loss model is
fitted by dual coordinate descent, and margins become probabilities by a
logistic curve fitted on rows the model has not seen. The model is a weight
vector of fixed size; fitting reads a bounded sample of the labelled rows,
scoring every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import slices
from postlens.llm.kernels import SPACES, U64, Words, combine, mix

DIM_BITS = 18
TRAIN_ROWS = 8192  # labelled rows used for fitting, at most
THRESHOLD = 0.3
HOLD_OUT = 5

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
                  else 4 if _c in " \t\r\f\v" else 5 if _c == "\n" else 6 + _b % 64)


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT == 0, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs without repeats, sorted by text."""
    w = Words(texts, SPACES, False)
    docs, hashes = [], []

    def put(doc, h, salt):
        docs.append(doc)
        hashes.append(h ^ U64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))

    def put_counts(doc, h, total, salt):
        """Each distinct value of a text, with its share as a power of two."""
        if not len(h):
            return
        key = np.stack((doc.astype(U64), h), 1)
        order = np.lexsort((h, doc))
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(key)))
        d, v = key[at, 0].astype(np.int64), key[at, 1]
        put(d, v, salt)
        share = np.floor(np.log2(n / total[d]) * 2).astype(np.int64)
        put(d, mix(v ^ mix(share.view(U64))), salt + 1)

    put(w.doc, w.hash, 1)
    if len(w.hash) > 1:
        two, same = combine(w.hash, 2), w.doc[1:] == w.doc[:-1]
        put(w.doc[:-1][same], two[same], 2)
    cls = _CLASS[w.data]
    n = len(cls)
    if n:
        owner = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
        head = np.ones(n, bool)
        head[1:] = (cls[1:] != cls[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(head)
        runs, doc = mix(cls[at].astype(U64) + U64(1)), owner[at]
        total = np.maximum(np.bincount(doc, minlength=len(w.off) - 1), 1)
        for k in range(1, 5):
            g = combine(runs, k)
            ok = doc[: len(g)] == doc[k - 1: k - 1 + len(g)]
            put_counts(doc[: len(g)][ok], g[ok], total, 10 * k)
    # repeated words: the word before, the share of words seen earlier in the text
    m = len(w.hash)
    if m:
        words = np.maximum(np.diff(w.first), 1)
        order = np.lexsort((w.hash, w.doc))
        again = (w.hash[order][1:] == w.hash[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
        next_same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        for salt, flag_doc in ((61, w.doc[order][1:][again]), (62, w.doc[1:][next_same])):
            n_again = np.bincount(flag_doc, minlength=len(words))
            share = np.floor(20 * n_again / words).astype(U64)
            put(np.arange(len(words)), mix(share + U64(1)), salt)
            put(np.arange(len(words)), mix((share + U64(1)) * U64(1 << 20) + np.floor(np.log2(words)).astype(U64)), salt + 10)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    h = mix(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
    key = np.unique((doc.astype(U64) << U64(DIM_BITS)) | (h >> U64(64 - DIM_BITS)))
    return (key >> U64(DIM_BITS)).astype(np.int64), (key & U64((1 << DIM_BITS) - 1)).astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            dim: int, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of a linear model under the hinge loss (L2-regularised, ``cost`` per row)."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    norm = np.array([1.0 + v @ v for v in values])
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[dim]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                w[dim] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


@dataclass
class QualityModel:
    """``weights`` per feature (already scaled by the ratios), their ratios, bias and logistic curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(doc, self.ratios[feature] ** 2, n)) + 1e-9
        return np.bincount(doc, self.weights[feature], n) / length + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, feature = features(texts)
        z = self.slope * self.margins(doc, feature, len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit(rows: list[np.ndarray], y: np.ndarray, dim: int, alpha: float = 1.0, c: float = 1.0) -> QualityModel:
    n1, n0 = max((y > 0).sum(), 1), max((y < 0).sum(), 1)
    p, q = np.full(dim, alpha), np.full(dim, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    ratios = np.log((p / (n1 + 2 * alpha)) / (q / (n0 + 2 * alpha)))
    values = [ratios[r] / (np.sqrt((ratios[r] ** 2).sum()) + 1e-9) for r in rows]
    cost = np.where(y > 0, c, c * np.sqrt(n1 / n0))
    w = dual_coordinate_descent(rows, values, y, cost, dim)
    return QualityModel((w[:dim] * ratios).astype(np.float64), ratios, float(w[dim]), 1.0, 0.0)


def _logistic(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins (damped Newton steps)."""
    n1, n0 = (target > 0).sum(), (target < 0).sum()
    t = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack((margin, np.ones_like(margin)), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (t - p) - 1e-3 * (b - [1, 0]))
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """A model from at most ``train_rows`` labelled rows, none of them held out.

    Rows are taken in the order of a hash of their id. Null labels and ids are left
    out; a doc with several labels takes their rounded mean; repeated rows of
    a document count once. Without labelled rows of both classes there is no
    model (``None``).
    """
    known = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg("y").alias("y")))
    bound = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(bound), "doc_id").select("doc_id", "y", "text"))  # at most train_rows ids

    def extract(batches):
        for b in slices(batches, "text"):
            doc, feature = features(b.column(2))
            offs = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(feature.astype(np.int32)))], names=["doc_id", "y", "f"])

    got = rows.mapInArrow(extract, "doc_id long, y double, f array<int>")
    # at most train_rows rows: one task fits, the driver sees only the model
    fitted = got.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(
        _fit_rows, "weights binary, ratios binary, bias double, slope double, shift double").first()
    if fitted is None:
        return None
    return QualityModel(np.frombuffer(fitted["weights"]), np.frombuffer(fitted["ratios"]), fitted["bias"],
                        fitted["slope"], fitted["shift"])


def _fit_rows(rows: pa.Table) -> pa.Table:
    """The model of a bounded set of rows ``doc_id, y, f`` as one row; none without both classes."""
    empty = {"weights": pa.array([], pa.binary()), "ratios": pa.array([], pa.binary()),
             **{c: pa.array([], pa.float64()) for c in ("bias", "slope", "shift")}}
    rows = rows.sort_by("doc_id")
    ids = np.asarray(rows["doc_id"])
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    y = np.where(np.asarray(rows["y"])[first] >= 0.5, 1.0, -1.0)
    lists = rows["f"].combine_chunks()
    offs, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sets = [flat[offs[i]: offs[i + 1]] for i in first]
    if len(set(y)) < 2:
        return pa.table(empty)
    dim = 1 << DIM_BITS
    fold = np.arange(len(y)) % 4
    margin = np.zeros(len(y))
    for k in range(4):  # margins of rows that the model has not seen
        part = _fit([s for s, f in zip(sets, fold, strict=True) if f != k], y[fold != k], dim)
        for i in np.flatnonzero(fold == k):
            margin[i] = part.margins(np.zeros(len(sets[i]), np.int64), sets[i], 1)[0]
    model = _fit(sets, y, dim)
    slope, shift = _logistic(margin, y)
    return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()),
                     "ratios": pa.array([model.ratios.tobytes()], pa.binary()),
                     "bias": [model.bias], "slope": [slope], "shift": [shift]})


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null and empty texts are scored by the same model (no indicators but the
    empty ones). Without a model every score is 1. Null ids are not
    held out. Repeated rows are scored one by one; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    sent = _broadcast(docs, model)

    def run(batches):
        m = sent.value and QualityModel(*sent.value)
        for b in slices(batches, "text"):
            s = np.ones(b.num_rows) if m is None else m.scores(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _broadcast(docs: DataFrame, model: QualityModel | None):
    """The model for the tasks: 2 ** DIM_BITS weights and ratios, whatever the input."""
    parts = None if model is None else (model.weights, model.ratios, model.bias, model.slope, model.shift)
    return docs.sparkSession.sparkContext.broadcast(parts)


def accepted(docs: DataFrame, model: QualityModel | None, text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    sent = _broadcast(docs, model)

    def run(batches):
        m = sent.value and QualityModel(*sent.value)
        for b in slices(batches, text_col):
            text = b.column(b.schema.get_field_index(text_col))
            yield b if m is None else b.filter(pa.array(m.scores(text) >= threshold))

    return docs.mapInArrow(run, docs.schema)
