"""Language identification by sparse multinomial logistic regression.

Character n-grams of one to three letters, words padded by a space, are hashed
to BUCKETS; a text is its TF-IDF vector of unit length. Document frequencies
are counted over all training documents. Weights are learned by
follow-the-regularised-leader with an elastic net, a pass after another over a
bounded sample (of each language as many documents as SAMPLE has room for, those
with the smallest hash, EACH at least, so that no language is left
out however rare; a quarter of them is kept back), then the temperature is chosen
that makes the part kept back likeliest. Kept-back documents count by how many
documents of their language there are.

Defined results: a text that is null or has no letter is `und` with score 0;
null languages are not learned from; with no training document every text is
`und`; repeated rows are repeated; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import chunks, text_batches
from .quality import folds

BUCKETS = 1 << 14
#: Training documents that the weights are fitted on, of each language at least, and passes.
SAMPLE, EACH, PASSES = 4000, 24, 3
#: Temperatures that are tried.
HEATS = np.geomspace(0.01, 10, 90)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 1e-4


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, ascending, and how often each comes. Letters
    are lower-cased; whatever is no letter parts words."""
    s = (text or "").lower()
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    most = int(code.max())
    if most < 0x250:
        letter = _LETTER[code]
    else:
        kinds, at = np.unique(code, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds.tolist()])[at]
    code = np.where(letter, code, 32).astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    space = code == 32
    with np.errstate(over="ignore"):
        one = code * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
        h = np.concatenate([one[~space], two[~(space[:-1] & space[1:])], three[~space[1:-1]]])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50)
    n = np.bincount(h.astype(np.int64), minlength=BUCKETS)
    b = np.flatnonzero(n)
    return b, n[b]


_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


def weigh(b: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[b]
    return v / max(1e-12, np.sqrt((v**2).sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's documents; bucket -1: how many they are."""
    df, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            b, _ = grams(t)
            df[b] += 1
            docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[docs], df[at]]))], names=["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [grams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("lang"), pa.array([b.astype(np.int16).tobytes() for b, _ in got], pa.binary()), pa.array([np.minimum(n, 1 << 30).astype(np.int32).tobytes() for _, n in got], pa.binary())], names=["turn", "lang", "b", "n"])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader of a softmax, elastic net."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, b: np.ndarray) -> np.ndarray:
        z = self.z[b]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[b])) / ALPHA + L2))

    def learn(self, b: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(b)
        g = v[:, None] * (softmax(v @ w) - (np.arange(w.shape[1]) == y))
        sigma = (np.sqrt(self.n[b] + g * g) - np.sqrt(self.n[b])) / ALPHA
        self.z[b] += g - sigma * w
        self.n[b] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model from docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.xxhash64("doc_id", "text").alias("turn"), "text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = base.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, n_docs = np.zeros(BUCKETS), 0
    for r in counts.collect():  # a row for each bucket at most
        if r["bucket"] < 0:
            n_docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    if not n_docs:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # How many documents each language has: a row for each language.
    langs = base.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("least"))
    size = {r["lang"]: r["n"] for r in langs.collect()}
    most = max(EACH, sample // len(size))
    # Hashes are even, so one below this is about twice as many rows as are taken, and at least one.
    edge = F.greatest("least", (F.lit(float(-(1 << 63))) + F.least(F.lit(1.0), (2.0 * most + 64) / F.col("n")) * float(1 << 64)).cast("long"))
    picked = base.join(F.broadcast(langs.select("lang", edge.alias("edge"))), "lang").filter("turn <= edge").select("turn", "lang", "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "b"))
    rows = picked.mapInArrow(_vectors, "turn long, lang string, b binary, n binary").withColumn("at", turn).filter(F.col("at") <= most).orderBy("turn", "lang", "b").select("lang", "b", "n").collect()
    languages = sorted({r["lang"] for r in rows})
    place = {x: k for k, x in enumerate(languages)}
    data = []
    for r in rows:
        b = np.frombuffer(bytes(r["b"]), np.int16).astype(np.int64)
        if len(b):
            data.append((b, weigh(b, np.frombuffer(bytes(r["n"]), np.int32), idf), place[r["lang"]]))
    if not data:
        return None
    turn, kept, seen = [0] * len(languages), [], []
    for x in data:
        # Of each language every fourth.
        (kept if turn[x[2]] % 4 == 3 else seen).append(x)
        turn[x[2]] += 1
    kept = kept or seen
    model = Ftrl(len(languages))
    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(seen)):
            model.learn(*seen[i])
    w = model.weights(np.arange(BUCKETS))
    logits, y = np.array([v @ w[b] for b, v, _ in kept]), np.array([k for _, _, k in kept])
    # As the languages are sampled evenly, their shares come back as weights. One error among
    # the documents kept back is reckoned with, so that a part without any does not mean certainty.
    weight = np.array([size[x] for x in languages]) / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    doubt = 1 / (len(y) + 2)

    def loss(heat: float) -> float:
        logs = np.log(softmax(logits / heat) + 1e-300)
        own = logs[np.arange(len(y)), y]
        others = (logs.sum(1) - own) / max(1, len(languages) - 1)
        return float(-(weight[y] * ((1 - doubt) * own + doubt * others)).sum())

    heat = min(HEATS, key=loss)
    return {"languages": languages, "w": w.astype(np.float32), "idf": idf, "heat": float(heat)}


def _predicted(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in chunks(list(range(batch.num_rows)), batch.column("text").to_pylist()):
            lang, score = [], []
            for t in texts:
                b, n = grams(t)
                if not len(b) or model is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = softmax(weigh(b, n, model["idf"]) @ model["w"][b] / model["heat"])
                lang.append(model["languages"][int(p.argmax())])
                score.append(float(p.max()))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("held_out").take(at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each of docs (doc_id,
    text, lang). Learned from those whose crc32(doc_id) mod 5 is not 0."""
    held = folds(docs, 5, 0)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held)))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return asked.mapInArrow(lambda it: _predicted(it, model.value), "doc_id long, held_out boolean, lang_pred string, score double")
