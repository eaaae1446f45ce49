"""Quality rules: per-document counts, and lines that too many documents of a host share.

Base counts come from whole texts in one pass. The rule across documents hashes every
normalised line (lower case, single blanks), counts the distinct documents of each host
that hold it, and removes the lines above the limit; a document that keeps too few of
its words is rejected. Documents are told apart by their ids, so copies count each, and
a page that a host serves again and again is depleted; the limit is a number of
documents, the same for small and large hosts.

Lines travel as hashes. A first count is of rows, by partial sums; only lines that it
puts above the limit, a small part of all, are counted by distinct ids, which spreads a
hot line over all its documents. The frequent lines are broadcast where their number is
small and joined by a shuffle that splits hot keys where it is not; a hot host is only
half of each key.

Defined results: null and empty texts have no words and fail the base rule; a null host
is a host of its own; rows without an id are a document each; repeated rows count once
and get equal results; an empty table gives no rows; other columns are ignored, whatever
their names. A text of any length is worked on in stretches (textbytes.STRETCH_BYTES).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import shared
from kithgraph.llm.textbytes import SPACES, STRETCH_BYTES, several, stretches, texts_of, windows, word_hashes

#: A line is frequent if more documents of its host hold it.
MOST_DOCUMENTS = 20
#: A document is depleted below this part of its words or this many words.
LEAST_PART, LEAST_WORDS = 0.5, 10
#: Frequent lines up to which they are broadcast.
BROADCAST_ROWS = 200_000
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
#: Bytes that are no first byte of a code point outside white space.
_NO_CHARACTER = SPACES + bytes(range(0x80, 0xC0))


def lines_of(text: bytes) -> Iterator[bytes]:
    """The lines of a text, split at newlines; the pieces at hand stay small."""
    at = 0
    while at <= len(text):
        cut = text.find(b"\n", at + STRETCH_BYTES)
        end = cut if cut >= 0 else len(text)
        yield from text[at:end].split(b"\n")
        at = end + 1


def line_hash(line: bytes) -> tuple[int, int]:
    """The hash of a normalised line and its number of words."""
    if len(line) <= STRETCH_BYTES:
        words = line.lower().split()
        return xxhash.xxh3_64_intdigest(b" ".join(words)), len(words)
    whole, n = xxhash.xxh3_64(), 0
    for part in stretches(line):
        words = part.lower().split()
        if words:
            whole.update(b" " * (n > 0) + b" ".join(words))
        n += len(words)
    return whole.intdigest(), n


def counts_of(text: bytes) -> tuple[tuple[int, ...], dict[int, int]]:
    """The counts of a text in the order of _COUNTS, and the words of each of its different normalised lines by hash."""
    h = word_hashes(text)
    # Words inside windows that occur more than once.
    begins = np.flatnonzero(several(windows(h, WINDOW)))
    cover = np.zeros(len(h) + 1, np.int32)
    cover[begins] += 1
    cover[begins + WINDOW] -= 1
    seen: set[int] = set()
    lines: dict[int, int] = {}
    with_words = 0
    for line in lines_of(text):
        normal, n = line_hash(line)
        if n:
            with_words += 1
            seen.add(xxhash.xxh3_64_intdigest(line))
            lines[normal] = lines.get(normal, 0) + n
    repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    return (len(h), len(text.translate(None, _NO_CHARACTER)), len(text) - len(text.translate(None, _SYMBOLS)), with_words - len(seen),
        repeated), lines


def measured(docs: DataFrame) -> DataFrame:
    """Counts of every document (doc_id, text, source), with its host and its lines as (hash, words)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in shared.pieces(batches, "text"):
            counts, lines = zip(*map(counts_of, texts_of(data, offsets)), strict=True)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
            n = int(bounds[-1])
            line = np.fromiter((h for x in lines for h in x), np.uint64, n).view(np.int64)
            words = np.fromiter((w for x in lines for w in x.values()), np.int32, n)
            each = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(line), pa.array(words)], names=["line", "words"]))
            columns = [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), each]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *_COUNTS, "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    host = F.xxhash64(F.col("source").isNull(), "source").alias("host")
    return docs.select("doc_id", host, "text").mapInArrow(make,
        f"doc_id {kind}, host long, {', '.join(f'{k} long' for k in _COUNTS)}, lines array<struct<line: long, words: int>>")


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def frequent_lines(rows: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """host and line of every line that more than `most` distinct documents of the host hold; rows are staged and numbered (row)."""
    held = rows.select("doc_id", "row", "host", F.explode("lines.line").alias("line"))
    often = shared.staged(held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most).select("host", "line"), "rules-often")
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    own_row = F.when(F.col("doc_id").isNull(), F.col("row"))
    documents = held.join(often, ["host", "line"]).select("host", "line", "doc_id", own_row.alias("own_row")).distinct()
    return documents.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most).select("host", "line")


def judged(docs: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """doc_id, the counts, n_words_left, base_failed and kept for docs (doc_id, text, source)."""
    rows = shared.staged(measured(docs).withColumn("row", F.monotonically_increasing_id()), "rules")
    frequent = shared.staged(frequent_lines(rows, most), "rules-frequent")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    lines = rows.select("host", "row", F.explode("lines").alias("l")).select("host", "row", "l.line", "l.words")
    gone = lines.join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (left < LEAST_WORDS) | (left < LEAST_PART * F.col("n_words"))
    out = rows.drop("lines").join(gone, "row", "left")
    return out.select("doc_id", *_COUNTS, left.cast("long").alias("n_words_left"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
