"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features are the word uni- and bigrams, the uni- and bigrams of word shapes (letters by
case, digits, other bytes, runs collapsed), and what n-grams are like among themselves
(a bigram of one word twice, a trigram that the text had before), all hashed into one
table of weights. Executors turn labelled texts into sparse vectors; the driver gets at most
SAMPLE of them, chosen by a hash of their ids, and learns. Scoring hashes the words of
whole texts and adds up weights; it needs no shuffle.

Defined results: null and empty texts have no n-grams and score by the bias alone;
without any labels every score is 0.5; an empty table gives no rows; equal texts get
equal scores; an id with both labels is learnt from once with each, repeated rows with
one label and text once for each row; other columns are carried on, whatever their names.
A text of any length is worked on in stretches (textbytes.STRETCH_BYTES).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.llm import shared
from kithgraph.llm.textbytes import again, hashes, mixed, stretches, texts_of, windows

#: Bits of a feature's number.
BITS = 18
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 6000
#: Most feature numbers of theirs, which bounds what the driver holds (12 bytes each).
NUMBERS = 16_000_000
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(1, 7)]


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = 65, 97, 48, 97
    return table


_SHAPE = _shapes()
#: N-grams whose feature numbers are made at once.
_AT_ONCE = 1 << 18


def _word_and_shape_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words, shapes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for part in stretches(text):
        words.append(hashes(part.split()))
        shape = _SHAPE[np.frombuffer(part, np.uint8)]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        shapes.append(hashes(shape[keep].tobytes().split()))
    return np.concatenate(words), np.concatenate(shapes)


def features(text: bytes) -> Iterator[np.ndarray]:
    """The feature numbers of all n-grams of a text, some at a time."""
    words, shapes = _word_and_shape_hashes(text)
    for seed, h, n in zip(_SEEDS[:4], (words, shapes, words, shapes), (1, 1, 2, 2), strict=True):
        for lo in range(0, max(0, len(h) - n + 1), _AT_ONCE):
            yield (mixed(windows(h[lo : lo + _AT_ONCE + n - 1], n) ^ seed) >> np.uint64(64 - BITS)).astype(np.int64)
    # N-grams like others, whatever their words: one feature number for each kind.
    for seed, times in zip(_SEEDS[4:], (int((words[1:] == words[:-1]).sum()), int(again(windows(words, 3)).sum())), strict=True):
        yield np.full(times, int(seed) >> (64 - BITS))


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each feature number
    bias: float

    def score(self, text: bytes) -> float:
        """The dot product is the mean weight of the text's n-grams, scaled as in training."""
        total, count = 0.0, 0
        for numbers in features(text):
            total += float(self.weights[numbers].sum(dtype=np.float64))
            count += len(numbers)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + total / max(count, 1)))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3,
    epochs: int = 4, seed: int = 7) -> Model:
    """FTRL-proximal on (numbers, values, label); each coordinate has its own rate, and z and n as state."""
    size = (1 << BITS) + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    rare = max(1, sum(1 for e in examples if e[2] == 0)), max(1, sum(1 for e in examples if e[2] == 1))
    lift = [min(4.0, max(1.0, rare[1 - y] / rare[y])) ** 0.5 for y in (0, 1)]
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            numbers, values, label = examples[k]
            at = np.append(numbers, size - 1)
            x = np.append(values, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x * lift[label]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def vector_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different feature numbers of a text, and the part of its n-grams that each is."""
    numbers, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in features(text):
        new, n = np.unique(part, return_counts=True)
        numbers, place = np.unique(np.concatenate([numbers, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(numbers)).astype(np.int64)
    return numbers, counts / max(1, int(counts.sum()))


def vectors(docs: DataFrame) -> DataFrame:
    """label, numbers and values (parts of all n-grams) of labelled docs (doc_id, text, label)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in shared.pieces(batches, "text"):
            numbers, values = zip(*map(vector_of, texts_of(data, offsets)), strict=True)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (np.concatenate(numbers)
                .astype(np.int32), np.concatenate(values).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "numbers", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "label").mapInArrow(make, f"doc_id {kind}, label int, numbers array<int>, values array<float>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = NUMBERS) -> Model:
    """Learn quality from labels (doc_id, quality), on at most `sample` of its rows with crc32(doc_id) mod 3 not 1.

    They come in the order of a hash of their ids, until their vectors have `most` numbers.
    """
    usable = labels.where((shared.crc_of() % 3 != 1) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = shared.thinned(usable.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id", sample)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # At most `sample` rows of an id and a label, and about `most` numbers of features in all.
    rows = vectors(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = shared.staged(rows.withColumn("row", F.monotonically_increasing_id()), "quality-vectors")
    order = [F.xxhash64("doc_id"), "doc_id", "label", "row"]
    sizes = rows.select("row", "doc_id", "label", F.size("numbers").alias("n")).orderBy(*order).limit(sample)
    held = sizes.withColumn("_held", F.sum("n").over(Window.orderBy(*order))).where(F.col("_held") <= most).select("row")
    found = rows.join(F.broadcast(held), "row").orderBy(*order).toArrow()
    if not found.num_rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    pick = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    label = found.column("label").to_numpy()
    numbers, values = found.column("numbers").combine_chunks(), found.column("values").combine_chunks()
    bounds = numbers.offsets.to_numpy()
    n, v = numbers.values.to_numpy(), values.values.to_numpy().astype(np.float64)
    return train([(n[bounds[k] : bounds[k + 1]], v[bounds[k] : bounds[k + 1]], int(label[k])) for k in pick])


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) and score, which replaces one of that name."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    schema = docs.select(*names).withColumn("score", F.lit(0.0)).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in shared.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([model.score(t) for t in texts_of(data, offsets)],
                pa.float64())], names=[*names, "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(make, schema)


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, as they are, that score `least` or more."""
    rows, back = shared.set_aside(docs)
    return scored(rows, model).where(F.col("score") >= least).select(*back)
