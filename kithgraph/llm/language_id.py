"""Language identification by a small byte convolutional network.

Filters of widths 2, 3 and 4 over learnt byte embeddings, max pooling over windows of
WINDOW bytes, and a softmax; trained in numpy on labelled texts. For scoring, each
filter is turned into tables of whole numbers over byte pairs and bytes, so a window's
activations are a few look-ups and additions, and results do not depend on batches. A
text is all its windows, which overlap by what the widest filter needs; its language is
the one with the largest mean probability, weighted by bytes.

Defined results: und with score 0 where a text is null or has no letter, and for every
text if there is nothing to learn from; of languages with equal probability the first by
name; equal texts get equal results; an empty table gives no rows; other columns are
carried on, whatever their names. Windows of a text of any length are worked on some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import shared

WINDOW = 64
WIDTHS = (2, 3, 4)
#: Bytes from one window to the next, so that every n-gram of a text lies in one of them.
STRIDE = WINDOW - max(WIDTHS) + 1
FILTERS, EMBEDDED = 8, 8
#: Texts for each language that the network is trained on, at most.
SAMPLE = 400
#: Characters of the stretches of a text that are trained on, and their number.
STRETCH, STRETCHES = 160, 3
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDED)
    filters: list[np.ndarray]  # (width, EMBEDDED, FILTERS) for each width
    filter_bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """For each width whole-number tables by byte pair (and by byte for an odd rest), and their scales."""
        found, scales = [], []
        for w in self.filters:
            single = [self.embedding @ w[k] for k in range(len(w))]
            scale = 30000 / max(1e-9, sum(np.abs(s).max() for s in single))
            pair = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(w) - 1, 2)]
            found.append([np.round(t * scale).astype(np.int16) for t in pair + single[len(w) - len(w) % 2 :]])
            scales.append(np.full(w.shape[2], 1 / scale))
        return found, np.concatenate(scales)

    def scorer(self) -> _Scorer:
        return _Scorer(self, *self.tables())


@dataclass
class _Scorer:
    network: Network
    by_width: list[list[np.ndarray]]
    scale: np.ndarray

    def windows(self, bytes_: np.ndarray) -> np.ndarray:
        """(n, languages) probabilities of (n, WINDOW) bytes."""
        pairs = bytes_[:, :-1].astype(np.uint16) << 8 | bytes_[:, 1:]
        pooled = []
        for width, tables in zip(WIDTHS, self.by_width, strict=True):
            n = bytes_.shape[1] - width + 1
            act = tables[0].take(pairs[:, :n], axis=0)
            for k, table in enumerate(tables[1:], 1):
                act += table.take((pairs if len(table) > 256 else bytes_)[:, 2 * k : 2 * k + n], axis=0)
            pooled.append(act.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) * self.scale + self.network.filter_bias, 0)
        return _softmax(hidden @ self.network.out + self.network.out_bias)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): the mean probabilities of each row's windows by the bytes that each adds."""
        size = np.diff(offsets)
        each = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE)), 0)
        first = np.cumsum(each) - each
        rows = np.repeat(np.arange(len(size)), each)
        nth = np.arange(len(rows)) - first[rows]
        start, end = offsets[:-1][rows] + nth * STRIDE, offsets[1:][rows]
        weight = np.where(nth == each[rows] - 1, size[rows] - STRIDE * nth, STRIDE)
        total = np.zeros((len(size), len(self.network.languages)))
        for lo in range(0, len(rows), 2048):
            some = slice(lo, lo + 2048)
            at = start[some, None] + np.arange(WINDOW)
            bytes_ = np.where(at < end[some, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
            np.add.at(total, rows[some], weight[some, None] * self.windows(bytes_))
        return total / np.maximum(size, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the mean cross-entropy of (n, WINDOW) bytes."""
    rng = np.random.default_rng(seed)
    hidden = len(WIDTHS) * FILTERS
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDED)), "b": np.zeros(hidden), "o": rng.normal(0, 0.3, (hidden, len(languages))), "c": np.zeros(
        len(languages))}
    p |= {f"w{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, EMBEDDED, FILTERS)) for w in WIDTHS}
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            x, y = windows[order[lo : lo + 64]], label[order[lo : lo + 64]]
            e = p["e"][x]
            best, top = [], []
            for w in WIDTHS:
                act = sum(e[:, k : x.shape[1] - w + 1 + k] @ p[f"w{w}"][k] for k in range(w))
                best.append(act.argmax(axis=1))
                top.append(np.take_along_axis(act, best[-1][:, None, :], 1)[:, 0])
            pre = np.concatenate(top, axis=1) + p["b"]
            h = np.maximum(pre, 0)
            d = _softmax(h @ p["o"] + p["c"])
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            dh = (d @ p["o"].T) * (pre > 0)
            grad = {"o": h.T @ d, "c": d.sum(axis=0), "b": dh.sum(axis=0), "e": np.zeros_like(p["e"])}
            for i, w in enumerate(WIDTHS):
                part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros_like(p[f"w{w}"])
                for k in range(w):
                    at = x[np.arange(len(x))[:, None], best[i] + k]  # the byte that each filter's maximum saw
                    g[k] = np.einsum("nf,nfd->df", part, p["e"][at])
                    np.add.at(grad["e"], at.ravel(), (part[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, EMBEDDED))
                grad[f"w{w}"] = g
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                square[k] = 0.999 * square[k] + 0.001 * grad[k] ** 2
                p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from docs (doc_id, text, lang) with crc32(doc_id) mod 5 not 0, on about `sample` texts a language at most."""
    usable = docs.where((shared.crc_of() % 5 != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    named = docs.where((shared.crc_of() % 5 != 0) & F.col("lang").isNotNull())
    common = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not common:
        return None
    # The part of each language that gives about twice the sample; the hash of the id chooses.
    part = F.create_map(*(x for r in common for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * sample / r["count"])))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    span = F.length("text") - STRETCH
    stretches = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(span, F.lit(0)) + 1)
        .cast("int") + 1, STRETCH) for k in range(STRETCHES)]
    chosen = usable.where(chance < part[F.col("lang")]).select("lang", F.xxhash64("doc_id").alias("h"), F.array(*stretches).alias("stretches"))
    found = chosen.orderBy("h", "lang", "stretches").limit(2 * sample * len(common)).toPandas()
    found = found.groupby("lang", sort=False).head(sample)
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    rng = np.random.default_rng(11)
    windows, label = [], []
    for lang, texts in zip(found["lang"], found["stretches"], strict=True):
        for text in texts:
            body = np.frombuffer(text.encode("utf-8"), np.uint8)
            at = int(rng.integers(0, max(1, len(body) - WINDOW + 1)))
            cut = body[at : at + (WINDOW if rng.random() < 0.8 else int(rng.integers(4, WINDOW)))]
            windows.append(np.pad(cut, (0, WINDOW - len(cut))))
            label.append(languages.index(lang))
    return train(np.stack(windows), np.array(label), languages)


def predicted(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None), lang_pred and score, which replace those of their names."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    if network is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    languages = np.array([*network.languages, UNKNOWN], object)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = network.scorer()
        for batch, data, offsets in shared.pieces(batches, "text"):
            chance = scorer.texts(data, offsets)
            letter = batch.column(flag).to_numpy(zero_copy_only=False)
            best = np.where(letter, chance.argmax(axis=1), len(network.languages))
            score = np.where(letter, np.clip(chance.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(languages[best]), pa.array(score)], names=[*names,
                "lang_pred", "score"])

    flag = "_letter" + "_" * max(map(len, names), default=0)  # longer than any name of docs
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(flag)
    return docs.select(*dict.fromkeys([*names, "text"]), letter).mapInArrow(make, schema)


def accepted(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """The rows of docs, as they are, whose language is known with a score of `least` or more."""
    rows, back = shared.set_aside(docs)
    return predicted(rows, network).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*back)
