"""Quality classifier: a Bradley-Terry ranking from preference pairs.

Texts become a vector of surface features and of hashed words, over the whole
text: the shares of kinds of bytes and of marks, the shape of words and lines,
and the square root of the share of words in each of BUCKETS buckets. A pair of
a preferred and a rejected text says that the first one's score is higher; the
scores are linear in the features and fitted by the logistic loss of feature
differences with a ridge penalty, over all pairs of a preferred and a rejected
row of all labelled rows. Their features are written to the shared folder once;
Newton's method then reads them twice a step: once for the scores' histograms (a
row is dealt to the two nearest of BINS + 1 points between -REACH and REACH, beyond
which scores count as these), which give every row its sum over all rows of the
other label, once for the sums of the gradient and of the second derivatives. What
the driver gets is of the model's size. A text is accepted from the quantile of all
these rows' scores on that separates as many as the labels reject; the score shown
is logistic around that threshold.

Defined results: null and empty texts have the features of an empty text;
repeated documents and labels count as often as they come in training, and each
document gets its score; with labels of one kind only, or none, every score is
0.5; columns other than those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, materialize, release, text_batches

#: Newton steps at most; histograms of scores: their ends, their bins, and the fewer ones of the second derivatives' cross terms.
RIDGE, STEPS = 1e-3, 20
REACH, BINS, COARSE = 32.0, 16384, 256
_KIND = np.zeros(256, dtype=np.uint8)  # 0 other ASCII punctuation, 1 lower, 2 upper, 3 digit, 4 white, 5 beyond ASCII
for _lo, _hi, _k in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (9, 14, 4), (32, 33, 4), (128, 256, 5)):
    _KIND[_lo:_hi] = _k
_MARKS = b"#$%&*!|.,;:?/<>[]{}=_~^+@-\"'()"
#: Buckets of hashed words.
BUCKETS = 512
N_SURFACE = 6 + len(_MARKS) + 15
N_FEATURES = N_SURFACE + BUCKETS


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes and of marks, the shape of words and lines, and hashed words."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, dtype=np.uint8)
    words = raw.split()
    if not words:
        out[N_SURFACE - 1] = 1
        return out
    words_of = Counter(words)
    n, w, counts = len(b), len(words), np.bincount(b, minlength=256)
    out[:6] = np.bincount(_KIND, weights=counts, minlength=6) / n
    out[6 : 6 + len(_MARKS)] = np.minimum(1, counts[list(_MARKS)] / w)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kind = _KIND[b]
    edge = np.concatenate([[True], kind[:-1] == 4]) & (kind != 4)
    last = np.concatenate([kind[1:] == 4, [True]]) & (kind != 4)
    first, end = kind[edge], b[last]
    ends = np.bincount(end, minlength=256)
    out[6 + len(_MARKS) : N_SURFACE] = [
        np.log1p(w) / 10, sizes.mean() / 10, sizes.std() / 10, sizes.max() / 100 if sizes.max() < 100 else 1, len(words_of) / w, len(set(lines)) / len(lines), w / len(lines) / 50, np.mean(sizes <= 3),
        (first == 2).mean(), (first == 0).mean(), ends[[46, 33, 63]].sum() / w, ends[44] / w, ends[[35, 36, 37, 38, 42, 124]].sum() / w, np.mean(sizes == 1), 0]
    bucket = np.fromiter((crc32(x.lower()) % BUCKETS for x in words_of), np.int64, len(words_of))
    out[N_SURFACE:] = np.sqrt(np.bincount(bucket, weights=list(words_of.values()), minlength=BUCKETS) / w)
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in chunks(list(range(batch.num_rows)), batch.column("text").to_pylist()):
            x = [features(t).astype(np.float32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(rows)), batch.column("n").take(pa.array(rows)), pa.array(x, pa.binary())], names=["label", "n", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, numbers of times and features of some rows at a time."""
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield batch.column("label").to_numpy(), batch.column("n").to_numpy().astype(float), x.astype(float)


def _standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -6, 6)


def _moments(blocks: Iterator[tuple]) -> np.ndarray:
    """For each label the number of rows, the sums of features and of their squares."""
    out = np.zeros((2, 1 + 2 * N_FEATURES))
    for y, n, x in blocks:
        for c in (0, 1):
            k = n * (y == c)
            out[c] += np.concatenate([[k.sum()], k @ x, k @ x**2])
    return out


def _histograms(blocks: Iterator[tuple], model: dict) -> np.ndarray:
    """For each label how many rows score what; each row is dealt to the two points next to it."""
    out = np.zeros((2, BINS + 2))
    for y, n, x in blocks:
        at = (np.clip(_standard(model, x) @ model["w"], -REACH, REACH) + REACH) * (BINS / (2 * REACH))
        low = at.astype(np.int64)
        for c in (0, 1):
            k = n * (y == c)
            out[c] += np.bincount(low, k * (1 - at + low), BINS + 2) + np.bincount(low + 1, k * (at - low), BINS + 2)
    return out[:, : BINS + 1]


def _between(blocks: Iterator[tuple], model: dict, lo: float, hi: float) -> np.ndarray:
    """How many rows score below lo, in each of BINS parts from lo to hi, and from hi on."""
    out = np.zeros((1, BINS + 2))
    for _, n, x in blocks:
        at = np.floor((_standard(model, x) @ model["w"] - lo) * (BINS / (hi - lo)))
        out[0] += np.bincount((np.clip(at, -1, BINS) + 1).astype(np.int64), n, BINS + 2)
    return out


def _derivatives(blocks: Iterator[tuple], model: dict, pull: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The gradient, the second derivatives but for the cross terms, and for these
    each label's sums of features by score. pull and bend: by label and score, what
    a row's pairs add to the first and second derivative by its score."""
    points = np.linspace(-REACH, REACH, BINS + 1)
    gradient, second, cross = np.zeros((1, N_FEATURES)), np.zeros((N_FEATURES, N_FEATURES)), np.zeros((2 * (COARSE + 1), N_FEATURES))
    for y, n, x in blocks:
        z = _standard(model, x)
        s = np.clip(z @ model["w"], -REACH, REACH)
        first, curve = (np.where(y == 1, np.interp(s, points, f[1]), np.interp(s, points, f[0])) * n for f in (pull, bend))
        gradient[0] += first @ z
        z32 = z.astype(np.float32)
        second += (z32 * curve[:, None].astype(np.float32)).T @ z32
        np.add.at(cross, y * (COARSE + 1) + np.rint((s + REACH) * (COARSE / (2 * REACH))).astype(np.int64), z * n[:, None])
    return np.concatenate([gradient, second, cross])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of vectors, from rows in the order of slot."""
    slot, total = None, np.empty(0)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "v"])
    for batch in batches:
        for k, v in zip(batch.column("slot").to_pylist(), batch.column("v").to_pylist()):
            if slot is not None and k != slot:
                yield row()
            total = np.frombuffer(v) if k != slot else total + np.frombuffer(v)
            slot = k
    if slot is not None:
        yield row()


def _summed(rows: DataFrame, shape: tuple[int, int], of, *args) -> np.ndarray:
    """The sum over all tasks of what `of` makes of a task's rows. Each row of that
    matrix is added up in one task, in the order of the addends, so that it comes out alike."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = of(_blocks(batches), *args)
        own = np.flatnonzero(part.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([part[i].tobytes() for i in own], pa.binary())], names=["slot", "v"])

    parts = rows.mapInArrow(each, "slot int, v binary").repartition("slot").sortWithinPartitions("slot", "v")
    out = np.zeros(shape)
    for r in parts.mapInArrow(_vectors, "slot int, v binary").collect():
        out[r["slot"]] = np.frombuffer(bytes(r["v"]))
    return out


def _over(counts: np.ndarray, f) -> np.ndarray:
    """At each point the sum over counts of f of (this point less the other one)."""
    size = 1 << (3 * BINS + 1).bit_length()
    kernel = f(np.arange(-BINS, BINS + 1) * (2 * REACH / BINS))
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[BINS : 2 * BINS + 1]


def _sigmoid(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-d))


def _bend(d: np.ndarray) -> np.ndarray:
    return _sigmoid(d) * _sigmoid(-d)


def fit(rows: DataFrame) -> dict | None:
    """Weights and threshold from rows (label, n, x), x being features and n how
    often a row counts; None if one label lacks. The loss is the mean over all
    pairs of log(1 + exp(-difference of scores)), and RIDGE / 2 times the weights' squares."""
    moments = _summed(rows, (2, 1 + 2 * N_FEATURES), _moments)
    sizes = moments[:, 0]
    if not sizes.all():
        return None
    total = sizes.sum()
    mean, square = moments.sum(0)[1:].reshape(2, -1) / total
    model = {"mean": mean, "scale": np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3, "w": np.zeros(N_FEATURES)}
    # Words are sparse: what few texts have would weigh most.
    model["scale"][N_SURFACE:] = 0.5
    found = np.zeros((2, BINS + 1))
    found[:, BINS // 2] = sizes
    loss = lambda: found[1] / sizes[1] @ _over(found[0] / sizes[0], lambda d: np.logaddexp(0, -d)) + RIDGE / 2 * model["w"] @ model["w"]
    best = loss()
    coarse = np.linspace(-REACH, REACH, COARSE + 1)
    for _ in range(STEPS):
        share = found / sizes[:, None]
        pull = np.array([_over(share[1], _sigmoid) / sizes[0], -_over(share[0], lambda d: _sigmoid(-d)) / sizes[1]])
        bend = np.array([_over(share[1 - c], _bend) / sizes[c] for c in (0, 1)])
        sums = _summed(rows, (1 + N_FEATURES + 2 * (COARSE + 1), N_FEATURES), _derivatives, model, pull, bend)
        bad, good = sums[1 + N_FEATURES :].reshape(2, COARSE + 1, -1) / sizes[:, None, None]
        cross = good.T @ _bend(coarse[:, None] - coarse) @ bad
        gradient, second = sums[0] + RIDGE * model["w"], sums[1 : 1 + N_FEATURES] - cross - cross.T
        # Sums in single precision and by coarse scores: what they leave below zero is none.
        value, vector = np.linalg.eigh((second + second.T) / 2)
        move = -vector @ ((vector.T @ gradient) / (np.maximum(value, 0) + RIDGE))
        gain = -float(gradient @ move)
        if gain < 1e-9:
            break
        was = model["w"]
        for half in range(8):
            model = {**model, "w": was + move / 2**half}
            found = _summed(rows, (2, BINS + 1), _histograms, model)
            if (now := loss()) <= best + 1e-9:
                break
        best = now
        if gain < 1e-6:
            break
    return {**model, "threshold": _threshold(rows, model, found.sum(0), total, sizes[0])}


def _threshold(rows: DataFrame, model: dict, found: np.ndarray, total: float, rejected: float) -> float:
    """The quantile of scores: as many below as the labels reject, or, so that a
    score on the edge is rare, the middle of the widest gap near it."""
    k = np.clip(rejected, 1, total - 1)
    near = max(1, total / 200)
    upto, points = np.cumsum(found), np.linspace(-REACH, REACH, BINS + 1)
    lo = points[max(0, int(np.searchsorted(upto, max(0.5, k - near))) - 1)]
    hi = points[min(BINS, int(np.searchsorted(upto, min(total - 0.5, k + near))) + 1)]
    # Shares of dealt rows place ranks to a bin; the range may hold a few ranks more.
    below = np.cumsum(_summed(rows, (1, BINS + 2), _between, model, lo, hi)[0])
    width = (hi - lo) / BINS
    # Edge i, at lo + i * width, has below[i] rows under it.
    some = np.flatnonzero((below[: BINS + 1] >= max(1, k - near)) & (below[: BINS + 1] <= min(total - 1, k + near)))
    if not len(some):
        return float(lo + width * np.abs(below[: BINS + 1] - k).argmin())
    # Runs of edges with as many rows below: gaps.
    runs = np.split(some, np.flatnonzero(np.diff(below[some])) + 1)
    gap = max(runs, key=lambda r: (len(r), -abs(below[r[0]] - k)))
    return float(lo + width * (gap[0] + gap[-1]) / 2)


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"] - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """A model from all of docs (doc_id, text) that labels (doc_id, 0/1) mark."""
    text_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    # At most two rows a document; hashing them spares the sorting of texts.
    marked = marked.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marked, "doc_id").select("label", "n", "text")
    rows = materialize(rows.mapInArrow(_featured, "label int, n long, x binary"), "features")
    try:
        return fit(rows)
    finally:
        release(rows)


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with a column score (0 to 1) for their text."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    scored = F.pandas_udf(lambda t: _series(t, sent.value), "double")
    return docs.withColumn("score", scored(F.col("text")))


def _series(texts, model):
    import pandas as pd

    # A few texts at a time; their whole batch has been bounded by text_batches.
    parts = [score(model, np.array([features(t) for t in own]).reshape(-1, N_FEATURES)) for _, own in chunks(list(range(len(texts))), list(texts))]
    return pd.Series(np.concatenate(parts) if parts else np.empty(0))


def folds(docs: DataFrame, modulus: int, held: int) -> F.Column:
    """Whether crc32(doc_id as text) mod modulus is `held`; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each of docs. Labels are
    learned from documents whose crc32(doc_id) mod 3 is not 1."""
    held = folds(docs, 3, 1)
    model = train(docs.filter(~held), labels)
    out = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
