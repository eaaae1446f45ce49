"""Near copies by shingles: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, components.

Candidates come from minwise hashing: BANDS keys of ROWS minima each, so a pair at exactly
0.8 shares no key in about one of 80,000 cases, and closer pairs more rarely still. Texts
that keys connect form a cluster. In a block of texts every link is found by the shingles
themselves: a search from text to text compares each with those not yet reached that share
one of its rarest shingles (a prefix that no pair at 0.8 can avoid), so nothing in a block
is missed, what is reached once is not compared again, and pairs are never written.

A key that a third of all texts have is shuffled once for each piece of texts, since texts
of a piece that share a key are linked where they are read. A block holds about BLOCK shingles. Most clusters are one block. Larger ones, such as one
very large family of near copies or texts chained by chance keys, are dealt into blocks;
what is linked inside them contracts to one text each, which are dealt again until that
joins no more. Where a cluster still has several components, each key that texts of
several components have is searched: all texts but those of its heaviest component are
queries against all of its texts, block by block. So no task holds more than two blocks,
and a link between texts of a common key is found whatever the cluster's size.

Texts whose fingerprints link as op6_simhash links them belong together too; components
are those of both kinds of links.

Defined results: texts with fewer words than a shingle have one shingle of all their words;
null, empty and blank texts are copies of one another; exact copies are one vertex (a hash
of 64 bits of the text); of a component the row with the smallest id stays, one without an
id only where none has any; rows that repeat id and text stay once; other columns are
carried on, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import shared, simhash
from kithgraph.llm.textbytes import hashes, mixed, texts_of, windows, word_hashes

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST, OF = 4, 5
BANDS, ROWS = 48, 7
#: Shingles of a block.
BLOCK = 4_000_000
#: Rows of hashes (two numbers each) up to which a table of them is broadcast.
BROADCAST_ROWS = 500_000
_RANDOM = np.random.default_rng(7)
_XORS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of every row (or some) of UTF-8, ascending, and the rows' bounds in them; no row is without one."""
    found = []
    for text in texts_of(data, offsets) if rows is None else (data[offsets[r] : offsets[r + 1]].tobytes() for r in rows.tolist()):
        h = windows(word_hashes(text, lower=True), SHINGLE)
        found.append(np.unique(h) if len(h) else hashes([b" ".join(text.lower().split())]))
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int64)


def keys_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of minima over each row's shingles."""
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(bounds) - 1, b + 1, np.uint64)
        for x, f in zip(_XORS[b], _FACTORS[b], strict=True):
            key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.minimum.reduceat((h ^ x) * f, bounds[:-1]))
        out[:, b] = key
    return out


def linked(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every row the first row of its component under similarity of at least LEAST / OF."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[inverse]
    token = token[np.lexsort((token, row))]  # the rarest first in each row
    prefix = sizes - -(-LEAST * sizes // OF) + 1
    in_prefix = np.arange(len(token)) - bounds[row] < prefix[row]
    label, open_ = np.full(n, -1), np.ones(n, bool)
    mark = np.zeros(len(count), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        some = in_prefix & open_[row]
        order = np.argsort(token[some], kind="stable")
        return token[some][order], row[some][order]

    (posted, holder), indexed, left = index(), n, n
    for first in range(n):
        if not open_[first]:
            continue
        label[first], open_[first], left = first, False, left - 1
        queue = [first]
        while queue and left:
            if 2 * left < indexed:
                (posted, holder), indexed = index(), left
            p = queue.pop()
            own = token[bounds[p] : bounds[p + 1]]
            lo, hi = (np.searchsorted(posted, own[: prefix[p]], side) for side in ("left", "right"))
            near = np.unique(holder[_spans(lo, hi)])
            near = near[open_[near] & (OF * sizes[near] >= LEAST * sizes[p]) & (OF * sizes[p] >= LEAST * sizes[near])]
            if not len(near):
                continue
            mark[own] = True
            shared_ = np.add.reduceat(mark[token[_spans(bounds[near], bounds[near + 1])]], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            mark[own] = False
            near = near[(LEAST + OF) * shared_ >= LEAST * (sizes[near] + sizes[p])]
            label[near], open_[near], left = first, False, left - len(near)
            queue.extend(near.tolist())
    return label


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places from lo to hi of each span, one span after the other."""
    each = hi - lo
    return np.arange(each.sum()) + np.repeat(lo - (np.cumsum(each) - each), each)


def vertex() -> Column:
    """Exact copies of a text are one vertex."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in shared.pieces(batches, "text"):
        keys = keys_of(*shingles_of(data, offsets)).view(np.int64)
        bounds = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))], names=[
            "vertex", "keys"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and vertex of every different text of a piece, once for each key of the piece; edges to the rest.

    Texts of a piece that share a key are linked at once: an edge is a row with the other
    text, and with that as its key, so that a key of many texts is shuffled a few times only.
    """
    for batch, data, offsets in shared.pieces(batches, "text"):
        v = batch.column("vertex").to_numpy(zero_copy_only=False)
        rows = np.sort(np.unique(v, return_index=True)[1])
        key = keys_of(*shingles_of(data, offsets, rows)).ravel().view(np.int64)
        vertex_ = np.repeat(v[rows], BANDS)
        order = np.argsort(key, kind="stable")
        key, vertex_ = key[order], vertex_[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = vertex_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        other = pa.array(np.where(new, 0, vertex_), mask=new)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(new, key, vertex_)), pa.array(head), other], names=["key", "vertex", "other"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges among rows, and one from the first vertex of each run of equal keys to each other; rows come sorted, a run may go on."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "vertex"))
        made = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
        u, w = v[made], batch.column("other").fill_null(0).to_numpy(zero_copy_only=False)[made]
        key, v = key[~made], v[~made]
        if len(key):
            if last:
                key, v = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], v])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = v[np.flatnonzero(new)[np.cumsum(new) - 1]]
            last = key[-1], head[-1]
            some = head != v
            u, w = np.concatenate([u, head[some]]), np.concatenate([w, v[some]])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], names=["u", "v"])


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vertex and root for what is linked to another text of its block; rows come sorted by block, which may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # vertices, shingles and their number, of one block
    of = None

    def out() -> pa.RecordBatch:
        v, h, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        label = linked(h, np.concatenate([[0], np.cumsum(sizes)]))
        some = label != np.arange(len(v))
        return pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(v[label[some]])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "vertex"))
        each = batch.column("shingles")
        bounds = each.offsets.to_numpy()
        h = each.values.to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and block[a] != of:
                yield out()
                held.clear()
            of = block[a]
            # A text that is both query and row of its block comes twice, one after the other.
            some = np.flatnonzero(np.concatenate([[not held or held[-1][0][-1] != v[a]], v[a + 1 : b] != v[a : b - 1]])) + a
            if len(some):
                held.append((v[some], h[_spans(bounds[some], bounds[some + 1])], bounds[some + 1] - bounds[some]))
    if held:
        yield out()


def _by_blocks(rows: DataFrame) -> DataFrame:
    """u, v: edges inside blocks of rows (block, vertex, shingles)."""
    return rows.select("block", "vertex", "shingles").repartition("block").sortWithinPartitions("block", "vertex").mapInArrow(_linked_blocks,
        "u long, v long")


def _places(blocks: Column, *salt: Column) -> Column:
    """Which of a group's blocks a text is dealt to."""
    return F.pmod(F.xxhash64("vertex", *salt), blocks)


def _blocks(weight: Column, size: int) -> Column:
    return F.ceil(weight / size).cast("long")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in shared.pieces(batches, "text"):
        h, bounds = shingles_of(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("vertex"), batch.column("cluster"), pa.array(np.diff(bounds)), lists], names=[
            "vertex", "cluster", "n", "shingles"])


def _components(edges: list[DataFrame], most: int) -> DataFrame:
    """vertex and label of everything with an edge, of `most` vertices."""
    found = simhash.components(reduce(DataFrame.unionByName, edges))
    return shared.staged(found.select(F.col("node").alias("vertex"), F.col("root").alias("label")), "similar-labels", most)


def _joined(rows: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with what is broadcast if it is small."""
    return rows.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def _links_of_large(texts: DataFrame, keys: DataFrame, found: DataFrame, block: int) -> list[DataFrame]:
    """Edges of clusters of several blocks, besides those found inside blocks; texts has vertex, cluster, n, shingles."""
    edges = [found]
    total = texts.count()
    known, before = _components(edges, total), math.inf
    # One text of each component, dealt anew while that joins a tenth of them.
    while (left := total - known.where("vertex <> label").count()) <= 0.9 * before:
        before = left
        firsts = _joined(texts, known, "vertex", "left").where("label is null or label = vertex").drop("label")
        weight = firsts.groupBy("cluster").agg(_blocks(F.sum("n"), block).alias("blocks"), F.count("*")
            .alias("texts")).where("texts > 1").drop("texts")
        dealt = _joined(firsts, shared.staged(weight, "similar-weights", left), "cluster")
        edges.append(shared.staged(_by_blocks(dealt.withColumn("block", F.xxhash64("cluster", _places(F.col("blocks"), F.lit(len(edges)))))),
            "similar-edges"))
        known = _components(edges, total)
    # Keys that texts of several components have.
    owned = _joined(texts.select("vertex", "n"), known, "vertex", "left").select("vertex", "n", F.coalesce("label", "vertex").alias("label"))
    dealt = shared.staged(_joined(keys, owned, "vertex"), "similar-owned")
    parts = dealt.groupBy("key", "label").agg(F.sum("n").alias("n"))
    mixed_ = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*")
        .alias("labels")).where("labels > 1")
    mixed_ = mixed_.select("key", F.col("main.label").alias("main"), _blocks(F.col("n"), block).alias("rows"), _blocks(F.col("n") - F.col(
        "main.n"), block).alias("queries"))
    some = _joined(dealt.select("key", "vertex", "label"), shared.staged(mixed_, "similar-mixed"), "key")
    as_row = some.select("key", "vertex", _places(F.col("rows")).alias("r"), F.explode(F.sequence(F.lit(0)
        .cast("long"), F.col("queries") - 1)).alias("q"))
    as_query = some.where("label <> main").select("key", "vertex", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
        .alias("r"), _places(F.col("queries"), F.lit("q")).alias("q"))
    pairs = as_row.unionByName(as_query).select("vertex", F.xxhash64("key", "r", "q").alias("block"))
    return [*edges, shared.staged(_by_blocks(pairs.join(texts.select("vertex", "shingles"), "vertex")), "similar-edges")]


def keyed(texts: DataFrame) -> DataFrame:
    """vertex and key of every different text, BANDS rows each."""
    keys = texts.mapInArrow(_keys, "vertex long, keys array<long>").dropDuplicates(["vertex"])
    return keys.select("vertex", F.explode("keys").alias("key"))


def linked_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """vertex and root (one vertex of the component) of every text (docs.text) that is linked to a different one."""
    texts = docs.select(vertex().alias("vertex"), "text")
    dealt = texts.mapInArrow(_dealt, "key long, vertex long, other long").repartition("key").sortWithinPartitions("key", "vertex")
    edges = shared.staged(dealt.mapInArrow(_stars, "u long, v long").distinct(), "similar-candidates")
    near = simhash.components(edges).select(F.col("node").alias("vertex"), F.col("root").alias("cluster"))
    near = shared.staged(near, "similar-clusters", 2 * edges.count())
    # Copies of a text are one row before they meet a table that is too large to broadcast.
    most = near.count()
    few = most <= BROADCAST_ROWS
    some = texts.join(F.broadcast(near), "vertex").dropDuplicates(["vertex"]) if few else texts.dropDuplicates(["vertex"]).join(near, "vertex")
    some = shared.staged(some.mapInArrow(_shingled, "vertex long, cluster long, n long, shingles array<long>"), "similar-shingles")
    weight = shared.staged(some.groupBy("cluster").agg(_blocks(F.sum("n"), block).alias("blocks")), "similar-weights", most)
    dealt = _joined(some, weight, "cluster")
    found = shared.staged(_by_blocks(dealt.withColumn("block", F.xxhash64("cluster", _places(F.col("blocks"))))), "similar-edges")
    large = weight.where("blocks > 1").select("cluster")
    links = [found]
    if not large.isEmpty():
        members_ = shared.staged(_joined(near, large, "cluster", "left_semi").select("vertex"), "similar-large")
        inside = _joined(found, members_.withColumnRenamed("vertex", "u"), "u", "left_semi").select("u", "v")
        keys = shared.staged(keyed(_joined(texts, members_, "vertex", "left_semi")), "similar-keys")
        links += _links_of_large(_joined(some, large, "cluster", "left_semi"), keys, inside, block)
    return _components(links, most).select("vertex", F.col("label").alias("root"))


def members(docs: DataFrame) -> DataFrame:
    """vertex and root of every text that shingles or fingerprints link to a different one."""
    near = linked_texts(docs).select(F.col("vertex").alias("u"), F.col("root").alias("v"))
    prints = simhash.near_duplicates(docs.select(vertex().alias("doc_id"), "text"))
    return simhash.components(near.unionByName(prints.select(F.col("doc_id").alias("u"), F.col("component_id")
        .alias("v")))).select(F.col("node").alias("vertex"), "root")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: only rows that are linked replace one another, whatever their ids.

    What goes is decided on hashes and ids; the rows themselves are only filtered.
    """
    found = shared.staged(members(docs), "similar")
    tally = shared.staged(docs.select(vertex().alias("vertex"), "doc_id").groupBy("vertex", "doc_id")
        .agg(F.count("*").alias("copies")), "similar-tally")
    most = tally.count()
    firsts = tally.groupBy("vertex").agg(F.min("doc_id").alias("first"))
    best = F.min(F.struct(F.isnull("first").alias("none"), "first", "vertex")).alias("best")
    chosen = _joined(firsts, found, "vertex").groupBy("root").agg(best).select("best.vertex", "best.first")
    chosen = _joined(firsts, found, "vertex", "left_anti").unionByName(chosen)
    row = lambda of, doc_id: [F.col(of).alias("_vertex"), F.xxhash64(of, F.isnull(doc_id), doc_id).alias("_row")]
    chosen = shared.staged(chosen.select(*row("vertex", "first")), "similar-chosen", most)
    counted = tally.select(*row("vertex", "doc_id"), "copies")
    gone = shared.staged(counted.join(chosen, ["_vertex", "_row"], "left_anti").drop("copies"), "similar-gone", most)
    twice = shared.staged(counted.where("copies > 1").join(chosen, ["_vertex", "_row"], "left_semi").drop("copies"), "similar-twice", most)
    rows, back = shared.set_aside(docs)
    own = f"_doc{docs.columns.index('doc_id')}"
    rows = rows.withColumn("_vertex", vertex()).withColumn("_row", F.xxhash64("_vertex", F.isnull(own), own))
    kept = _joined(rows, gone, ["_vertex", "_row"], "left_anti")
    if not twice.isEmpty():  # of rows that repeat id and text, one
        once = _joined(kept, twice, ["_vertex", "_row"], "left_semi").dropDuplicates(["_vertex", "_row"])
        kept = _joined(kept, twice, ["_vertex", "_row"], "left_anti").unionByName(once)
    return kept.select(*back)
