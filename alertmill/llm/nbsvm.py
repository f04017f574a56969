"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model on them.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``) by dual coordinate descent, and every
document is then scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.textbytes import lean, mixed, slices
from alertmill.llm.tokens import forget_encoders

SAMPLE_ROWS = 8_000  # labelled rows the model is fitted on at most
WORK_BYTES = 1 << 18  # bytes of text whose n-grams are sorted at once; a longer text is taken alone
HELD_ROWS = 64  # rows whose margins are taken at once while the curve is set
FEATURE_BITS = 17  # n-grams share 2^17 places, so a model never has more weights
GRAMS = (1, 2, 3)  # lengths of the byte n-grams
MIX = 0.9  # how far the weights go from their mean size to the fitted ones (the rest is plain Naive Bayes)
COST, ROUNDS, SMOOTHING = 30.0, 12, 1.0
DAMPING = 1.0  # added to a row's squared length, so that a short text does not weigh like a long one
PACKED_NAMES = ["doc_ids", "labels", "sizes", "places"]  # of all rows of a slice


@dataclass
class Model:
    weights: np.ndarray  # of an indicator, already scaled by its ratio
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each distinct n-gram of every row."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide, keys = data.astype(np.uint64), []
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        gram = np.full(count, n, dtype=np.uint64)
        for k in range(n):
            gram = gram << np.uint64(8) | wide[k : k + count]
        place = mixed(gram) >> np.uint64(64 - FEATURE_BITS)
        whole = row_of[:count] == row_of[n - 1 :]
        keys.append((row_of[:count][whole].astype(np.uint64) << np.uint64(FEATURE_BITS)) | place[whole])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def log_count_ratios(places: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << FEATURE_BITS), SMOOTHING)
    for own, label in zip(places, labels, strict=True):
        counts[label, own] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(places: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and bias of the hinge-loss model, by coordinate descent on its dual.

    Rows have unit length at most and both classes the same total cost.
    """
    sign = labels * 2.0 - 1.0
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    cost = COST * 0.5 / share[labels]
    scale = np.array([1.0 / np.sqrt(np.square(ratios[p]).sum() + DAMPING) for p in places])
    square = np.array([np.square(ratios[p] * s).sum() + 1.0 for p, s in zip(places, scale, strict=True)])
    alpha, weights, bias = np.zeros(len(places)), np.zeros(len(ratios)), 0.0
    order = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        moved = 0.0
        for k in order.permutation(len(places)):
            own, value = places[k], ratios[places[k]] * scale[k]  # made again each time: all of them are twice the places
            slope = sign[k] * (weights[own] @ value + bias) - 1.0
            new = min(max(alpha[k] - slope / square[k], 0.0), cost[k])
            step = (new - alpha[k]) * sign[k]
            if step:
                weights[own] += step * value
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3:
            break
    return weights, bias


def margins(rows: np.ndarray, places: np.ndarray, n_rows: int, model: Model) -> np.ndarray:
    ratio = model.ratios[places]
    total = np.bincount(rows, weights=model.weights[places] * ratio, minlength=n_rows)
    length = np.sqrt(np.bincount(rows, weights=np.square(ratio), minlength=n_rows) + DAMPING)
    return total / length + model.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to the chance of label 1."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * margin + shift)
        spread = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(spread * margin * margin).sum() + 1e-3, (spread * margin).sum()], [(spread * margin).sum(), spread.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(shift)


def fit(places: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on four fifths of the rows, set the curve on the rest; with a single class the score is its smoothed share."""
    n = np.bincount(labels, minlength=2)
    flat = np.zeros(1 << FEATURE_BITS)
    if n.min() < 5:
        return Model(flat, flat, 0.0, 0.0, float(np.log((n[1] + 1) / (n[0] + 1))))
    apart = np.random.default_rng(5).permutation(len(labels)) % 5 == 0
    inside = np.flatnonzero(~apart)
    ratios = log_count_ratios([places[k] for k in inside], labels[inside])
    weights, bias = dual_descent([places[k] for k in inside], labels[inside], ratios)
    mean = np.abs(weights).sum() / max(1, np.count_nonzero(weights))
    model = Model((1 - MIX) * mean + MIX * weights, ratios, MIX * bias, 1.0, 0.0)
    held, margin = [places[k] for k in np.flatnonzero(apart)], [np.zeros(0)]
    for first in range(0, len(held), HELD_ROWS):
        some = held[first : first + HELD_ROWS]
        margin.append(margins(np.repeat(np.arange(len(some)), [len(p) for p in some]), np.concatenate(some), len(some), model))
    model.slope, model.shift = calibrate(np.concatenate(margin), labels[apart])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on at most ``sample_rows`` labelled documents that are not held out, chosen by a hash of their id.

    Null labels and ids are left out; several labels of one document count by their mean. The sample is bounded, so its
    ids are broadcast and its indicators meet in one task, packed by slices of texts.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = wanted.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text", WORK_BYTES):
                rows, places = indicators(data, offsets)
                ids, of = (batch.column(c)[first:stop].to_numpy() for c in ("doc_id", "label"))
                packed = [ids.astype("<i8"), of.astype("<i4"), np.bincount(rows, minlength=stop - first).astype("<i4"), places.astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=PACKED_NAMES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        ids, of, sizes, places = [], [], [], []
        for batch in batches:
            for held, column, kind in zip((ids, of, sizes, places), batch.columns, ("<i8", "<i4", "<i4", "<i4"), strict=True):
                held.extend(np.frombuffer(x.as_buffer(), kind) for x in column)
        if not ids:
            return
        rows = [p for size, all_of in zip(sizes, places, strict=True) for p in np.split(all_of, np.cumsum(size)[:-1])]
        order = np.argsort(np.concatenate(ids), kind="stable")
        model = fit([rows[k] for k in order], np.concatenate(of)[order].astype(np.int64))
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.astype("<f8").tobytes(), "ratios": model.ratios.astype("<f8").tobytes(), "rest": [float(x) for x in (model.bias, model.slope, model.shift)]}])

    found = texts.mapInArrow(lean(features), ", ".join(f"{name} binary" for name in PACKED_NAMES))
    row = found.repartition(1).mapInArrow(lean(learn), "weights binary, ratios binary, rest array<double>").first()
    if row is None:  # nothing is labelled
        flat = np.zeros(1 << FEATURE_BITS)
        return Model(flat, flat, 0.0, 0.0, 0.0)
    return Model(np.frombuffer(row["weights"]), np.frombuffer(row["ratios"]), *row["rest"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The ``keep`` columns of every row and the score of its whole text (null: empty) from 0 to 1.

    The text may be a field of the struct ``inside``, one of ``keep``; then it is sent to the workers once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *(["text"] if "text" not in keep and not inside else []))
    fields = [rows.schema[k] for k in keep]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        known = sent.value
        for batch in batches:
            text = batch.column(inside).field("text") if inside else batch.column("text")
            for first, stop, data, offsets in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", WORK_BYTES):
                margin = margins(*indicators(data, offsets), stop - first, known)
                points = _sigmoid(known.slope * margin + known.shift)
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[first:stop] for k in keep), pa.array(points)], names=[*keep, "score"])

    return rows.mapInArrow(lean(give), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 if the score reaches ``threshold``).

    Null and empty texts are scored by the bias alone; repeated rows score alike.
    """
    scored = score(docs, train(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
