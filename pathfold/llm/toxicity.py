"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its distinct words and word beginnings (inflected forms
of one stem share them), word pairs and pairs around one or two skipped words. Each coordinate has its own learning rate; the L1 term keeps nearly all
weights at zero, so the model is a short sorted list of hashes and weights.

Edge cases: null and empty texts get the score of the bias alone; without labelled rows
every score is the bias of an untrained model; rows with a null label or id are not learnt
from; texts of any length are read whole; of ids that the draw's hash ties the lesser comes
first; repeated rows are scored alike; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm import wordhash
from pathfold.llm.columns import column, spare
from pathfold.llm.memory import tidy

#: Labelled rows learnt from at most (a uniform draw by hash), and passes over them.
SAMPLE = 12000
PASSES = 8
#: Features in fewer texts of the sample are not learnt.
LEAST_TEXTS = 3
BITS = 22
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 0.5
THRESHOLD = 0.7
SKIPS = (0, 1, 2)
STEMS = (4, 5)
#: Bytes of text whose features are made at once; they take about a hundred times as many.
BLOCK = 1 << 20
_FEATURE = np.uint64((1 << BITS) - 1)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The (row, feature) pairs of some texts, with repeats, as row << BITS | feature."""
    h, begin = wordhash.words(raw, offsets, wordhash.PUNCTUATION)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(begin))
    found = [(row, h)]
    for most in STEMS:
        found.append((row, wordhash.mix(wordhash.words(raw, offsets, wordhash.PUNCTUATION, most)[0] + np.uint64(most))))
    for skip in SKIPS:
        if len(h) > skip + 1:
            a, b = h[: len(h) - skip - 1], h[skip + 1 :]
            same = row[: len(a)] == row[skip + 1 :]
            found.append((row[: len(a)][same], wordhash.mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(skip + 1))[same]))
    return np.concatenate([r << np.uint64(BITS) | f >> np.uint64(64 - BITS) for r, f in found])


class Ftrl:
    """FTRL-proximal with per-coordinate rates over hashed binary features."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1, np.float32), np.zeros((1 << bits) + 1, np.float32)
        self.bias = 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        limit = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * limit) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= limit, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Features with a weight, their weights, and the bias."""
        live = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return live.astype(np.uint64), self.weights(live), float(self.weights(np.array([self.bias]))[0])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (key, label, features), which are put in order first."""
    kept, texts = [], np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for key, label, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.frombuffer(held, "<u4")
            kept.append((key, label, at))
            texts[at] += 1
    kept.sort(key=lambda x: (x[0], x[1], x[2].tobytes()))
    labels_left = [label for _, label, _ in kept]
    ends = np.cumsum([np.count_nonzero(texts[at] >= LEAST_TEXTS) for _, _, at in kept], dtype=np.int64)
    flat = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    while kept:  # each set goes as its features are copied, so both never exist whole
        at = kept.pop()[2]
        at, end = at[texts[at] >= LEAST_TEXTS], ends[len(kept)]
        flat[end - len(at) : end] = at
    del texts
    learner = Ftrl()
    for _ in range(PASSES):
        start = 0
        for label, end in zip(labels_left, ends, strict=True):
            learner.learn(flat[start:end].astype(np.int64), label)
            start = end
    live, weight, bias = learner.compact()
    yield pa.RecordBatch.from_arrays([pa.array([live.tobytes()]), pa.array([weight.astype("<f8").tobytes()]), pa.array([bias])], names=["live", "weight", "bias"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most `sample` labelled rows that are not held out.

    The draw orders rows by a hash of the id, so it is uniform and the same in every run. The
    features of the draw are hashed where the texts are; the sequential learner is one task,
    whose input the sample bounds, and only the weights reach the driver.
    """
    chosen = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label"))
    chosen = chosen.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.crc32(F.col("id").cast("string")) % 3 != 1))
    chosen = chosen.withColumn("key", F.xxhash64("id", F.lit(7))).orderBy("key", "id", "label").limit(sample)
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets in wordhash.blocks(batch.column(2), BLOCK):
                pairs = np.unique(features(raw, offsets))
                cuts = np.searchsorted(pairs, np.arange(to - at + 1, dtype=np.uint64) << np.uint64(BITS))
                low = (pairs & _FEATURE).astype("<u4")
                sets = [low[cuts[i] : cuts[i + 1]].tobytes() for i in range(to - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(sets, pa.binary())], names=["key", "label", "features"])

    found = rows.select("key", "label", "text").mapInArrow(tidy(hashed), "key long, label int, features binary")
    model = found.repartition(1).mapInArrow(tidy(_learn), "live binary, weight binary, bias double").first()
    return np.frombuffer(model["live"], np.uint64), np.frombuffer(model["weight"], "<f8"), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with keep, the row's own columns and
    a score so named.

    The model is broadcast; L1 bounds its size by the number of features of the sample.
    """
    live, weight, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((live, weight, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_feature, w, b = shared.value
        table = np.zeros(1 << BITS, bool)
        table[at_feature.astype(np.int64)] = True
        for batch in batches:
            out = []
            for at, to, raw, offsets in wordhash.blocks(batch.column(batch.num_columns - 1), BLOCK):
                pairs = features(raw, offsets)
                found = np.unique(pairs[table[(pairs & _FEATURE).astype(np.int64)]])
                value = w[np.searchsorted(at_feature, found & _FEATURE)] if len(found) else np.zeros(0)
                total = b + np.bincount((found >> np.uint64(BITS)).astype(np.int64), value, to - at)
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            s = np.concatenate(out) if out else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    (name,) = spare(docs, keep or "score")
    columns = docs.columns if keep else [id_col]
    place = [f"c{i}" for i in range(len(columns))]  # mapInArrow takes plain names only
    schema = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(place, columns, strict=True)) + ", score double"
    rows = docs.select(*(column(c).alias(p) for p, c in zip(place, columns, strict=True)), column(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(tidy(run), schema).toDF(*columns, name)
    if keep:
        return scored
    held = F.coalesce(F.crc32(column(id_col).cast("string")) % 3 == 1, F.lit(False))
    return scored.select(column(id_col).alias("doc_id"), held.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below the threshold."""
    (name,) = spare(docs, "score")
    return score(docs, train(docs, labels), keep=name).filter(F.col(name) < THRESHOLD).select(*map(column, docs.columns))


QUERY = "op8_toxicity"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = None
