"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from atalaya.llm.common import rows_of, whole_text

SLOTS = 1 << 18
#: Labelled rows that a model is fitted on at most, those with the smallest hashes of their ids.
SAMPLE = 8000
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Stands for a word that repeats the word before it.
AGAIN = zlib.crc32(b"\0again")


class Features:
    """Texts to hashed word n-grams (single tokens and pairs): slots and values of length one."""

    def __init__(self, slots: int = SLOTS, remembered: int = 500_000):
        self.slots, self.remembered, self.known = slots, remembered, {}

    def _number(self, token: str) -> int:
        if len(self.known) >= self.remembered:
            self.known.clear()
        x = self.known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return x

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        known, number = self.known, self._number
        x = np.fromiter([known.get(t) or number(t) for t in tokens], np.uint64, len(tokens))
        word = np.fromiter([t[0].isalnum() for t in tokens], bool, len(tokens))
        words = x[word]
        words[1:][words[1:] == words[:-1]] = AGAIN
        x[word] = words
        pairs = (x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
        slot, count = np.unique(np.concatenate([x, pairs]) % np.uint64(self.slots), return_counts=True)
        value = np.log1p(count)
        return slot.astype(np.int64), value / np.sqrt((value**2).sum())


def follow_the_regularised_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    slots: int = SLOTS,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.001,
) -> np.ndarray:
    """Weights (the last one is the bias) after passes over rows of (slots, values, label)."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)
    w = np.zeros(slots + 1)
    for _ in range(epochs):
        for at, x, label in rows:
            at, x = np.append(at, slots), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    used = np.abs(z) > l1
    w[used] = -(z[used] - np.sign(z[used]) * l1) / ((beta + np.sqrt(n[used])) / alpha + l2)
    return w.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Every fifth id by checksum, never learnt from; null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, slots: int = SLOTS, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most `sample` labelled rows that are not held out; only texts are inputs.

    Null labels are left out, several labels of one id count as the highest. Without labelled rows all weights are
    zero, so that every score is one half. The sample is chosen from the labels alone, joined by broadcast (its
    size is the bound), turned into sparse rows where the texts are, and trained on in one task of bounded size.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("data"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(slots)
        for table in rows_of(batches):
            made = [make(t) for t in table.column("data").to_pylist()]
            columns = [
                table.column("id").combine_chunks(),
                table.column("label").combine_chunks(),
                pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()),
                pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "slots", "values"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        held.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["slots"]))
        rows = [(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["values"], "<f4"), r["label"]) for r in held]
        weights = follow_the_regularised_leader(rows, slots)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    rows = texts.join(F.broadcast(chosen), "id").mapInArrow(sparse, "id long, label int, slots binary, values binary")
    return np.frombuffer(rows.repartition(1).mapInArrow(train, "weights binary").first()["weights"], np.float32)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The input's columns with `quality_score` (0 to 1, a sparse dot product through the logistic function).

    Null and empty texts get the bias alone. The model has a fixed size, whatever the corpus.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        make = Features(len(w) - 1)
        for batch in parts:
            out = []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                slot, value = make(text or "")
                out.append(1 / (1 + np.exp(-np.clip(float(w[slot] @ value + w[-1]), -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "quality_score"]
            )

    if "quality_score" in docs.columns:
        docs = docs.drop("quality_score")
    kinds = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.mapInArrow(run, kinds)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at the threshold or higher, with their own columns.

    The model is fitted on the labelled rows of docs itself. Extra columns go through; a column named quality_score
    is replaced by the score and dropped.
    """
    names = [c for c in docs.columns if c != "quality_score"]
    return scores(docs, fit(docs, labels)).where(F.col("quality_score") >= threshold).select(*names)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
