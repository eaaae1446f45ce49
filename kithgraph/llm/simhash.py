"""SimHash near-duplicates: 64-bit fingerprints, links within a radius of two bits, components.

Fingerprints within two bits of one another agree on at least two of four 16-bit
blocks, so each different fingerprint goes into six buckets and meets there all it may
link to. Buckets over LIMIT are dealt again by two of four 8-bit blocks of the other 32
bits (by then 48 bits agree, so a bucket holds at most 2**16 fingerprints). Within
buckets, distances are computed bit-sliced: bit planes are stored vertically, one word
for 64 fingerprints, carry-save counters add up plane by plane, and words whose 64
fingerprints are all beyond the radius are abandoned. What leaves a bucket are the
edges of a spanning forest, never all pairs. Components come from alternating large
and small stars over the edges, each step written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and link like any
other; exact copies share a fingerprint and are one vertex; a null id never becomes a
component's id unless all ids in it are null; an empty table gives no rows; other columns
are ignored. A text of any length is worked on in stretches (textbytes.STRETCH_BYTES).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import shared
from kithgraph.llm.textbytes import stretches, texts_of

RADIUS = 2
#: Words of a shingle and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints in a bucket beyond which it is dealt again.
LIMIT = 16_384
#: Part of all rows above which a fingerprint's rows are joined where they are.
HOT_PART = 1e-4
#: Words of 64 comparisons that are worked on at once.
_AT_ONCE = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64) bits of 64-bit numbers, lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, from stretches that share shingle - 1 words."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for part in stretches(text):
        words = tail + part.lower().split()
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        for lo in range(0, len(h), _AT_ONCE):
            ones += bits_of(h[lo : lo + _AT_ONCE]).sum(axis=0, dtype=np.int64)
        total += len(h)
        tail = words[max(0, len(words) - shingle + 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every row of UTF-8."""
    return np.fromiter((fingerprint_of(t, shingle) for t in texts_of(data, offsets)), np.uint64, len(offsets) - 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a long with the fingerprint's 64 bits) for every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in shared.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(data, offsets)
                .view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, fp long")


def close_words(fp: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places with i < j < end[i] whose fingerprints differ in at most radius bits."""
    n = len(fp)
    width = -(-n // 64)
    planes = np.zeros((64, width * 64), np.uint8)
    planes[:, :n] = bits_of(fp).T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    first, last = (np.arange(n) + 1) // 64, (end - 1) // 64
    each = np.where(end > np.arange(n) + 1, last - first + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(each)])
    counters = (radius + 1).bit_length()
    for lo in range(0, int(bounds[-1]), _AT_ONCE):
        k = np.arange(lo, min(lo + _AT_ONCE, int(bounds[-1])))
        query = np.searchsorted(bounds, k, "right") - 1
        word = first[query] + k - bounds[query]
        low = np.maximum(query + 1 - 64 * word, 0).astype(np.uint64)
        high = np.minimum(end[query] - 64 * word, 64).astype(np.uint64)
        beyond = ~((_ALL << low) & (_ALL >> (np.uint64(64) - high)))
        count = [np.zeros(len(k), np.uint64) for _ in range(counters)]
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - ((fp[query] >> np.uint64(b)) & np.uint64(1)))
            full = _ALL
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
                full = full & (count[c] if (radius + 1) >> c & 1 else ~count[c])
            beyond |= full
            if b % 8 == 7:
                alive = beyond != _ALL
                if not alive.all():
                    query, word, beyond = query[alive], word[alive], beyond[alive]
                    count = [c[alive] for c in count]
                if not len(query):
                    break
        if len(query):
            found, bit = np.nonzero(bits_of(~beyond))
            yield query[found], 64 * word[found] + bit


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each place's smallest known partner) after linking places a and b."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        la, lb = la[differ], lb[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal keys."""
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(change, len(key)))
    keep = np.repeat(sizes > 1, sizes)
    key, fp, sizes = key[keep], fp[keep], sizes[sizes > 1]
    if not len(fp):
        return fp, fp
    label = np.arange(len(fp))
    for i, j in close_words(fp, np.repeat(np.cumsum(sizes), sizes), radius):
        label = joined(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a run may go on in the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_edges(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(key) and (cut := int(np.searchsorted(key, key[-1]))):
            yield out(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield out(key, fp)


def _block(fp: Column, k: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1))


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """u, v: edges whose components are those of all links between the different fingerprints (fp)."""
    fp = F.col("fp")
    pairs = list(combinations(range(4), 2))
    coarse = [F.lit(t << 32).bitwiseOR(F.shiftleft(_block(fp, a, 16), 16)).bitwiseOR(_block(fp, b, 16)) for t, (a, b) in enumerate(pairs)]
    dealt = distinct.select("fp", F.explode(F.array(*coarse)).alias("key"))
    most = len(pairs) * distinct.count() // limit  # keys that may be above the limit
    large = shared.staged(dealt.groupBy("key").count().where(F.col("count") > limit).select("key"), "simhash-large", most)
    if large.isEmpty():
        rows = dealt
    else:
        fine = []
        for t, (a, b) in enumerate(pairs):
            # Four 8-bit blocks of the two 16-bit blocks that the coarse key leaves open.
            rest = [_block(fp, 2 * c + h, 8) for c in range(4) if c not in (a, b) for h in (0, 1)]
            subs = [F.lit((64 + t * 6 + s) << 48).bitwiseOR(F.shiftleft(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), 16))
                .bitwiseOR(F.shiftleft(rest[i], 8)).bitwiseOR(rest[j]) for s, (i, j) in enumerate(pairs)]
            fine.append(F.when(F.shiftright("key", 32) == t, F.array(*subs)))
        again = dealt.join(large, "key", "left_semi").select("fp", F.explode(F.coalesce(*fine)).alias("key"))
        rows = dealt.join(large, "key", "left_anti").select("fp", "key").unionByName(again)
    return rows.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_edges, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every vertex with an edge (u, v); root is the smallest vertex of its component."""
    now = shared.staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # Large star: every larger neighbour of a vertex goes to the vertex's smallest one.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = shared.staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars", state[0])
        # Small star: every smaller neighbour, and the vertex itself, goes to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col(
            "m").alias("v")))
        now = shared.staged(small.distinct(), "stars", 2 * state[0])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v")
        .alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest id that links reach) for every document."""
    prints = shared.staged(fingerprints(docs), "simhash")
    distinct = shared.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows_")), "simhash-distinct")
    member = components(links(distinct))
    n = distinct.count()
    placed = shared.staged(member.join(distinct, member["node"] == distinct["fp"]).select("fp", "root", "first_id"), "simhash-members", n)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = placed.join(least, "root").select("fp", "component_id")
    classes = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "rows_")
    classes = shared.staged(classes, "simhash-classes", n)
    # Fingerprints with more than a part of all rows: at most 1 / HOT_PART of them, so they can be broadcast.
    total = distinct.agg(F.sum("rows_")).first()[0] or 0
    hot = F.col("rows_") > HOT_PART * total
    often = F.broadcast(classes.where(hot).select("fp", "component_id"))
    spread = prints.join(often.select("fp"), "fp", "left_anti").join(classes.where(~hot).select("fp", "component_id"), "fp")
    return prints.join(often, "fp").unionByName(spread).select("doc_id", "fp", "component_id")
