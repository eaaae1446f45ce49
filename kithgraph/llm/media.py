"""Media columns: payloads stored as GIF frames, and timed frames with colour histograms.

A payload is cut into frames of WIDTH by at most ROWS samples with a grey palette, so
that what the frames show is the payload again. Everything of a document happens in the
task that reads it; nothing is shuffled.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import gif, shared

WIDTH, ROWS = 64, 1024
#: Hundredths of a second for which a frame is shown.
DELAY = 10
#: Bins of a channel's histogram.
BINS = 8
_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def stored(payloads: list[bytes]) -> list[bytes]:
    """A GIF for each payload; payloads are positive multiples of WIDTH bytes."""
    images = []
    for p in payloads:
        grid = np.frombuffer(p, np.uint8).reshape(-1, WIDTH)
        frames = [gif.Frame(grid[k : k + ROWS], delay=DELAY, disposal=1) for k in range(0, len(grid), ROWS)]
        images.append(((WIDTH, min(ROWS, len(grid))), _GREY, frames))
    return gif.write(images)


def histogram(pixels: np.ndarray) -> np.ndarray:
    """(3, BINS) pixels of each channel in equal ranges."""
    flat = pixels.reshape(-1, 3) // (256 // BINS)
    return np.stack([np.bincount(c, minlength=BINS) for c in flat.T])


def as_gifs(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF) of the padded UTF-8 of every text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in shared.pieces(batches, "text"):
            size = np.diff(offsets)
            body = data.tobytes()
            padded = [body[a:b].ljust(max(1, -(-(b - a) // WIDTH)) * WIDTH, b"\0") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(),
                strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(stored(padded), pa.binary())], names=[
                "doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, n_bytes long, media binary")


def _files(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        files = batch.column("media")
        lo = held = 0
        for k in range(batch.num_rows):
            held += len(files[k].as_buffer() or b"")
            if held >= size or k == batch.num_rows - 1:
                yield batch.slice(lo, k + 1 - lo), files.slice(lo, k + 1 - lo).to_pylist()
                lo, held = k + 1, 0


def frames(media: DataFrame) -> DataFrame:
    """The timed frames of media (doc_id, media): frame, start_ms, end_ms, width, height and colour histograms."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in _files(batches):
            rows = []
            for k, images in enumerate(gif.read(files)):
                at = 0
                for n, f in enumerate(images):
                    red, green, blue = histogram(f.canvas).tolist()
                    rows.append((k, n, at, at + 10 * f.delay, f.canvas.shape[1], f.canvas.shape[0], red, green, blue))
                    at += 10 * f.delay
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(9)]
            long, longs = pa.int64(), pa.list_(pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns[1:], [pa.int32(), long, long, pa.int32(), pa.int32(), longs, longs, longs], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *arrays], names=["doc_id",
                "frame", "start_ms", "end_ms", "width", "height", "red", "green", "blue"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(make,
        f"doc_id {kind}, frame int, start_ms long, end_ms long, width int, height int, red array<long>, green array<long>, blue "
        f"array<long>")


def digests(media: DataFrame) -> DataFrame:
    """Read media (doc_id, n_bytes, media) back: digests of the payload and of the file, and a feature of all frames."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in _files(batches):
            rows = []
            for body, images in zip(files, gif.read(files), strict=True):
                parts, ms, n = [], 0, 0
                bins = np.zeros((3, BINS), np.int64)
                for f in images:
                    parts.append(f.part[:, :, 0].tobytes())
                    bins += histogram(f.part)
                    ms, n = ms + 10 * f.delay, n + 1
                payload = b"".join(parts)
                feature = f"frames={n};ms={ms};" + ";".join(f"{c}={','.join(map(str, b))}" for c, b in zip("rgb", bins.tolist(), strict=True))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(body), hashlib.sha256(body)
                    .hexdigest(), feature))
            long, text = pa.int64(), pa.string()
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [long, text, long, long, text, text], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], names=_DIGESTS)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(make,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 "
        f"string, feature string")


_DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read it back, and return the digests."""
    return digests(as_gifs(docs)).withColumn("n_bytes", F.col("n_bytes").cast("long"))
