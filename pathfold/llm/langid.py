"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier per bit predicts it from hashed byte
n-grams of the whole text. Decoding sums the logistic loss of every bit against each
codeword, weighted by how well the bit's classifier did on its sample, and takes the
codeword of least loss. A small distance to the runner-up flags the text as ambiguous.

Edge cases: texts that are null or have no letter are `und` with score 0; without labelled
rows every text is `und`; with one language it is always that one; repeated rows are
predicted alike; of languages with one loss the first by code point is taken, and flagged;
texts of any length are read whole; an empty table gives an empty result; ids may have any
type; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm import wordhash
from pathfold.llm.columns import column

#: Labelled texts learnt from at most, for each language (a uniform draw by hash).
SAMPLE = 500
#: Languages at most whose codes list every split; more get random splits.
EXHAUSTIVE = 6
BINS = 2048
ORDERS = (1, 2, 3)
ROUNDS = 120
#: A text whose best score is less than this above the second is flagged.
MARGIN = 0.2


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; no column is constant, repeated or the negative of another."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], float)
    rng, columns = np.random.default_rng(11), set()
    while len(columns) < 16 + 4 * int(np.ceil(np.log2(n))):
        c = rng.integers(0, 2, n) * 2 - 1
        c = c * c[0]
        if abs(int(c.sum())) < n:
            columns.add(tuple(int(x) for x in c))
    return np.array(sorted(columns), float).T


def profiles(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the square roots of its shares of hashed byte n-grams."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    low = wordhash.LOWER[raw].astype(np.uint32)
    total = np.zeros(n * BINS)
    code = np.zeros(len(low), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(low) < order:
            break
        code = code[: len(low) - order + 1] * np.uint32(257) + low[order - 1 :]
        if order in ORDERS:
            first, last = doc[: len(code)], doc[order - 1 :]
            bins = ((code + np.uint32(order)) * np.uint32(2654435761) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)
            same = first == last
            total += np.bincount((first * BINS + bins)[same], minlength=n * BINS)
    total = total.reshape(n, BINS)
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1)).astype(np.float32)


class Codes:
    """Binary logistic classifiers for the bits of the languages' codewords."""

    def __init__(self, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        self.w = np.zeros((BINS + 1, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Full-batch accelerated descent with balanced languages; trust is 1 - the bit's error."""
        if not self.code.shape[1] or not len(x):
            return
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        goal = self.code[y].astype(np.float32)
        share = 1 / np.bincount(y, minlength=len(self.languages))[y]
        share = (share / share.sum()).astype(np.float32)[:, None]
        w, ahead = self.w, self.w
        for t in range(ROUNDS):
            push = goal / (1 + np.exp(np.clip(goal * (x @ ahead), -30, 30)))
            new = ahead + 4 * (x.T @ (push * share)) - 1e-4 * ahead
            ahead, w = new + t / (t + 3) * (new - w), new
        self.w = w
        wrong = ((x @ w) * goal <= 0).mean(0)
        self.trust = np.maximum(1 - 2 * wrong, 0.05)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and its lead over the second."""
        n = len(self.languages)
        margin = x @ self.w[:-1] + self.w[-1]
        loss = np.zeros((len(x), n))
        for i in range(n):
            loss[:, i] = np.logaddexp(0, -margin * self.code[i]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        second = np.partition(p, -2, axis=1)[:, -2] if n > 1 else np.zeros(len(p))
        return best, top, top - second


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Codes:
    """Classifiers from at most `sample` whole texts of each language, none held out.

    Ranks are taken per language and hash range after a cut by range, so no language gathers
    in one task; the profiles (BINS numbers each) of the sample come to the driver.
    """
    rows = docs.select(column(id_col).alias("__id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(F.crc32(F.col("__id").cast("string")) % 4 != 2, F.lit(False)))
    draw = F.xxhash64("__id", F.lit(3))
    ids = rows.select("__id", "lang", draw.alias("draw")).withColumn("range", F.spark_partition_id() % 64)
    top = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "__id"))
    ids = ids.withColumn("r", top(["lang", "range"])).filter(F.col("r") <= sample).withColumn("r", top(["lang"])).filter(F.col("r") <= sample)
    chosen = ids.select("__id").distinct()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets in wordhash.blocks(batch.column(0), 1 << 20):
                p = profiles(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, to - at), pa.array([x.tobytes() for x in p], pa.binary())], names=["lang", "profile"])

    found = sorted((r["lang"], r["profile"]) for r in rows.join(F.broadcast(chosen), "__id").select("text", "lang").mapInArrow(describe, "lang string, profile binary").toLocalIterator())
    languages = sorted({lang for lang, _ in found})
    codes = Codes(languages)
    if found:
        x = np.stack([np.frombuffer(p, np.float32) for _, p in found])
        codes.fit(x, np.searchsorted(languages, [lang for lang, _ in found]))
    return codes


def predict(docs: DataFrame, codes: Codes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            names, scores, leads = [], [], []
            for _, _, raw, offsets in wordhash.blocks(batch.column(1), 1 << 20):
                seen = np.concatenate([[0], np.cumsum(letter[raw])])
                has = (seen[offsets[1:]] - seen[offsets[:-1]]) > 0
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
                if not model.languages:
                    names += ["und"] * len(has)
                    scores += [0.0] * len(has)
                    leads += [0.0] * len(has)
                    continue
                best, top, lead = model.decode(profiles(raw, offsets))
                names += [model.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                scores += np.where(has, top, 0.0).tolist()
                leads += np.where(has, lead, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([x < MARGIN for x in leads], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    found = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


QUERY = "op10_langid"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))


SQL = None
