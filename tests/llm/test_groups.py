"""Mixing, near-duplicates, chat snapshots, archives, media and the pipeline against plain Python."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from kithgraph.llm import chat, gif, media, mixing, shared, similar, simhash, warc
from pyspark.sql import functions as F
from tests.llm.conftest import SF, clashing, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- mixing


def _targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def _check_mix(df) -> None:
    got = mixing.mix(df).collect()
    size = defaultdict(int)
    source = defaultdict(list)
    data = df.collect()
    for r in data:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = _targets(size)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in data)
    for r in got:
        source[r["source"]].append(r)
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["copies"] <= 2 and 0 <= r["rate"] <= 2
    for s, some in source.items():
        taken = sum(r["copies"] * r["size"] for r in some)
        exact = sum(r["rate"] * r["size"] for r in some)
        assert exact == pytest.approx(target[s], rel=1e-6)
        assert abs(taken - target[s]) <= max((r["size"] for r in some), default=0) / 2 + 1


def test_mix(docs, odd, nothing):
    _check_mix(docs)
    _check_mix(odd)
    assert mixing.mix(nothing).collect() == []


def test_mix_agrees_with_reruns(docs):
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7, "text")))


def test_repeated_has_the_copies(docs, odd):
    for df in (docs, clashing(odd)):
        got = mixing.repeated(df)
        assert got.columns == df.columns
        expected = Counter()
        for r in mixing.mix(df).collect():
            expected[r["doc_id"]] += r["copies"]
        assert Counter(r["doc_id"] for r in got.collect()) == +expected


def _newton(size: np.ndarray, n: np.ndarray, target: float) -> np.ndarray:
    """Rates min(2, exp(a * size)) by halving."""
    low, high = -100.0, 100.0
    for _ in range(400):
        a = (low + high) / 2
        rate = np.minimum(2, np.exp(np.minimum(700, a * size / size.mean())))
        low, high = (a, high) if float((n * size * rate).sum()) < target else (low, a)
    return rate


def test_tilts_meet_their_constraints(spark):
    """All sources at once, against one at a time."""
    rng = np.random.default_rng(5)
    made, targets = [], []
    for k in range(40):
        size = np.unique(rng.integers(1, [30, 5000, 100_000][k % 3], int(rng.integers(1, 40))))
        n = rng.integers(1, 50, len(size))
        made += [(f"s{k}", False, int(a), int(b)) for a, b in zip(size, n, strict=True)]
        targets.append((f"s{k}", False, float((size * n).sum()) * [0.01, 0.3, 0.9, 1.0, 1.5, 1.99, 2.0, 0.0][k % 8]))
    histogram = table(spark, made, "_s string, _null boolean, size long, n long")
    found = {r["_s"]: r for r in mixing.tilted(histogram, table(spark, targets, "_s string, _null boolean, target double")).collect()}
    assert len(found) == len(targets)
    for s, _, target in targets:
        size, n = np.array([x[2:] for x in made if x[0] == s], float).T
        rate = np.minimum(2, np.exp(np.minimum(700, found[s]["at"] * size / found[s]["mean"])))
        assert float((n * size * rate).sum()) == pytest.approx(target, rel=1e-6, abs=1e-6)
        if 0 < target < 2 * float((n * size).sum()):
            assert np.allclose(rate, _newton(size, n, target), rtol=1e-4, atol=1e-9)


@pytest.mark.parametrize("ids", [None, 7])
def test_ties_are_decided_singly(spark, ids):
    """Rows that agree in everything, a hot source of them, and texts that share an id."""
    alike = [(ids, "ten words " * 5, "en", "a", None)] * 1600 + [(k, "other words of b " * 3, "en", "b", None) for k in range(100)]
    df = table(spark, alike)
    _check_mix(df)
    took = Counter(r["copies"] for r in mixing.mix(df).collect() if r["source"] == "a")
    again = Counter(r["copies"] for r in mixing.mix(df.repartition(5)).collect() if r["source"] == "a")
    assert took == again and mixing.repeated(df).where("source = 'a'").count() == sum(c * n for c, n in took.items())
    _check_mix(table(spark, [(ids, f"ten words {k} " * 5, "en", "a", None) for k in range(500)] + alike[-100:]))


# --- near-duplicates


def _print(text: str | None) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fp: list[int], ids: list) -> list:
    parent = list(range(len(fp)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return [least[find(i)] for i in range(len(fp))]


def test_near_duplicates(docs, odd, nothing):
    for df in (docs, odd, clashing(odd)):
        data = df.collect()
        fp = [_print(r["text"]) for r in data]
        want = [(r["doc_id"], f - (1 << 64) if f >> 63 else f, c) for r, f, c in zip(data, fp, _classes(fp, [r["doc_id"] for r in data]), strict=True)]
        assert rows(simhash.near_duplicates(df)) == sorted(want, key=repr)
    assert simhash.near_duplicates(nothing).collect() == []


def _planted(n: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]
    while len(out) < n:  # chains and clusters
        f = out[int(rng.integers(0, len(out)))]
        for _ in range(int(rng.integers(1, 4))):
            f ^= 1 << int(rng.integers(0, 64))
        out.append(f)
    return sorted({f - (1 << 64) if f >> 63 else f for f in out})


@pytest.mark.parametrize("limit", [16_384, 3])
def test_links_lose_nothing(spark, limit):
    fps = _planted(600, limit)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = dict(simhash.components(simhash.links(df, limit)).collect())
    want = _classes([f & (1 << 64) - 1 for f in fps], fps)
    assert {f: found.get(f, f) for f in fps} == dict(zip(fps, want, strict=True))


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fp = np.array([f & (1 << 64) - 1 for f in _planted(300, 9)], np.uint64)
    rng.shuffle(fp)
    end = np.minimum(len(fp), np.arange(len(fp)) // 100 * 100 + 100)
    for radius in (0, 1, 2, 5):
        got = {(int(a), int(b)) for i, j in simhash.close_words(fp, end, radius) for a, b in zip(i, j, strict=True)}
        assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, int(end[i])) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001)], "u long, v long")
    found = dict(simhash.components(edges).collect())
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


# --- near copies by shingles


def _shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _alike(texts: list[str | None]) -> set[tuple[int, int]]:
    sets = [_shingles(t) for t in texts]
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 9 * len(a & b) >= 4 * (len(a) + len(b))}


def _near_copies() -> list[str]:
    """Texts with 0 to 4 of 100 words replaced, so that similarities lie about 0.8; some share half their words only."""
    rng = np.random.default_rng(11)
    out = []
    for g in range(30):
        base = [f"g{g}w{i}" if i < 50 or g % 3 else f"common{i}" for i in range(100)]
        for k in range(6):
            words = list(base)
            for at in rng.integers(0, 100, k % 5):
                words[at] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [similar.BLOCK, 700, 100])
def test_near_copies_against_brute_force(spark, docs, odd, block):
    """With clusters of one block and of many."""
    made = table(spark, [(k, t, "en", "a", None) for k, t in enumerate(_near_copies())])
    for df in (made, docs, odd):
        texts = sorted({r["text"] or "" for r in df.collect()})
        parent = list(range(len(texts)))

        def find(i: int, parent: list[int] = parent) -> int:
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in _alike(texts):
            parent[find(i)] = find(j)
        data = table(spark, [(None, t, None, None, None) for t in texts])
        at = {r["v"]: texts.index(r["text"]) for r in data.select("text", similar.vertex().alias("v")).collect()}
        root = {at[r["vertex"]]: at[r["root"]] for r in similar.linked_texts(df, block).collect()}
        got, want = defaultdict(set), defaultdict(set)
        for i in range(len(texts)):
            got[root.get(i, i)].add(i)
            want[find(i)].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pipeline_leaves_no_near_copies(spark):
    rows_ = [(k, t, "en", "a", None) for k, t in enumerate(_near_copies())]
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, table(spark, rows_), SF).collect()]
    assert len(kept) < len(rows_) / 2 and not _alike(kept)


def test_rows_of_one_id_stay_unless_linked(spark, nothing):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    made = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, b, "en", "s", 3), (None, a, "en", "s", 4), (None, a[::-1], "en", "s", 5), (None, a[::-1], "en", "s", 6)]
    kept = similar.representatives(table(spark, made)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (0, a[::-1])])
    assert similar.representatives(nothing).collect() == []


# --- chat


def _conversations(turns: list[tuple]) -> list[tuple]:
    by = defaultdict(set)
    for conv, turn, role, text in turns:
        by[conv].add((turn, role, text))
    whole = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0]))] for c, v in by.items()}
    out = []
    for c, w in whole.items():
        same = [d for d, x in whole.items() if x == w]
        if any(len(x) > len(w) and x[: len(w)] == w for x in whole.values()):
            continue
        if c != min(same, key=lambda d: (d is None, d)):
            continue
        each = [f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in w]
        out += [(c, k + 1, len(w), len(same), sum(map(len, each[:k])), x) for k, x in enumerate(each)]
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def test_snapshots(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [b], 5: [a, b, c], 6: [c, a], 7: [(None, "x")], None: [a, b, ("user", "more")], 8: [a, c, b, a]}
    turns = [(k, n, r, t) for k, v in logs.items() for n, (r, t) in enumerate(v)]
    turns += [(9, None, "user", "hi"), (9, 5, "assistant", "hello"), (3, 0, "user", "hi")]  # null number, repeated row
    df = table(spark, turns, TURNS).repartition(4)
    assert rows(chat.formatted(df)) == _conversations(turns)
    assert rows(chat.formatted(df.withColumn("place", F.lit(1)).withColumn("copies", F.lit("x")))) == _conversations(turns)
    assert chat.formatted(table(spark, [], TURNS)).collect() == []


def test_conversations_of_any_length(spark):
    turns = [(1, k, "user", f"é{k}") for k in range(3000)] + [(2, k, "user", f"é{k}") for k in range(2000)] + [(3, 0, "user", "other")]
    assert rows(chat.formatted(table(spark, turns, TURNS).repartition(5))) == _conversations(turns)


def test_ids_of_other_types(spark):
    turns = [("a", k, "user", f"t{k}") for k in range(5)] + [("b", k, "user", f"t{k}") for k in range(3)] + [(None, 0, "user", "x")]
    df = table(spark, turns, TURNS.replace("conv_id long", "conv_id string"))
    assert rows(chat.formatted(clashing(df).withColumn("_conv", F.lit(1)))) == _conversations(turns)


# --- archives

PAGES = "page_id long, url string, html string"


def _pages(data: list[tuple]) -> list[tuple]:
    first = {}
    for page, _, html in data:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in data:
        body = (html or "").encode()
        f = first.get(html or "")
        visit = f is not None and page != f
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if visit else "response", f if visit else None))
    return sorted(out, key=repr)


def test_archives(spark):
    data = [(k, f"http://h/{k}", f"<html>{'é' * (k % 7)}{k % 5}</html>") for k in range(60)]
    data += [(100, None, None), (101, "u", ""), (3, "again", data[3][2]), (None, "none", "only here"), (None, "x", data[4][2]), (102, "http://x/\r\ny: z", "z" * 300_000)]
    for part in (data, data[:2], []):
        df = table(spark, part, PAGES)
        got = warc.read_archives(warc.write_archives(df)).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))
        assert rows(got) == _pages(part)


def test_real_files_are_read(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    for k, r in enumerate(warc.write_archives(df).collect()):
        (tmp_path / f"{k}.warc.zst").write_bytes(r["content"])
        magic, size = struct.unpack_from("<II", r["content"])
        assert magic == 0x184D2A5D and 0 < size < len(r["content"])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert rows(warc.read_archives(files).select(F.col("page_id").cast("long"), F.decode("payload", "utf-8"))) == rows(df.select("page_id", "html"))


@pytest.mark.parametrize("spoil", [lambda b: b[:-3], lambda b: b[:40] + b"\0\0\0\0" + b[44:], lambda b: b + b"junk-after-it"])
def test_broken_archives_are_refused(spoil):
    good = warc.archive([warc.record("response", "1", "u", warc.digest_of(b"payload"), 7, b"payload", None)], b"")
    assert [warc.parsed(b).payload for b in warc.frames(good)] == [b"payload"]
    with pytest.raises(warc.BadArchive):
        [warc.parsed(b) for b in warc.frames(spoil(good))]


def _written(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A record by hand."""
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z", **fields, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_records_of_all_types(spark):
    http = {"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://h/"}
    body = b"<html>hi</html>"
    sha = warc.digest_of(body)
    records = [
        _written("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        _written("request", http | {"Content-Type": "application/http;msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"),
        _written("response", http, b"HTTP/1.1 200 OK\r\n\r\n" + body),
        _written("response", http | {"WARC-Payload-Digest": "md5:abc", "X-Folded": "one\r\n two"}, b"HTTP/1.1 200 OK\r\n\r\n" + body),
        _written("response", http | {"WARC-Payload-Digest": f"sha1:{hashlib.sha1(body).hexdigest()}"}, b"HTTP/1.1 200 OK\r\n\r\n" + body),
        _written("revisit", http | {"WARC-Refers-To": "<urn:uuid:response>", "WARC-Payload-Digest": f"sha1:{sha}"}, b"HTTP/1.1 200 OK\r\n\r\n"),
        _written("revisit", {"WARC-Profile": "p"}, b""),
        _written("resource", {"Content-Type": "text/plain"}, b"as it is"),
        _written("metadata", {}, b""),
        _written("conversion", {"WARC-Target-URI": "u"}, b"text"),
    ]
    plain = b"".join(zstd.ZstdCompressor().compress(r) for r in records)
    got = warc.read_archives(table(spark, [(bytearray(plain),), (bytearray(warc.archive(records, b"")),), (None,), (bytearray(b""),)], "content binary")).collect()
    want = [("warcinfo", None, 13), ("request", "http://h/", 0), *[("response", "http://h/", len(body))] * 3, ("revisit", "http://h/", None), ("revisit", None, None), ("resource", None, 8), ("metadata", None, 0), ("conversion", "u", 4)]
    assert sorted(map(repr, ((r["record_type"], r["url"], r["payload_bytes"]) for r in got))) == sorted(map(repr, want * 2))
    assert {(r["refers_to"], r["payload_digest"]) for r in got if r["record_type"] == "revisit"} == {("<urn:uuid:response>", sha), (None, None)}
    assert {r["payload_digest"] for r in got if r["record_type"] == "response"} == {sha}
    assert {r["fields"].get("x-folded") for r in got} == {None, "one two"}


@pytest.mark.parametrize(
    "fields",
    [{"Content-Length": "12x"}, {"Content-Length": "-1"}, {"Content-Length": "\u0663"}, {"WARC-Block-Digest": "sha1:AAAA"}, {"WARC-Payload-Digest": "sha1:AAAA"}, {"no colon": None}, {"X-Payload-Length": "0"}, {"X-Payload-Length": "seven"}],
)
def test_malformed_headers_are_refused(fields):
    body = _written("resource", {}, b"payload")
    assert warc.parsed(body).payload == b"payload"
    for k, v in fields.items():
        line = f"{k}: {v}\r\n" if v is not None else f"{k}\r\n"
        bad = body.replace(b"Content-Length: 7\r\n", line.encode()) if k == "Content-Length" else body.replace(b"Content-Length", line.encode() + b"Content-Length")
        with pytest.raises(warc.BadArchive):
            warc.parsed(bad)
    for bad in (body.replace(b"<urn", b"\xff<urn"), body.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), body.replace(b"WARC-Date", b"WARC-Type: x\r\nWARC-Date")):
        with pytest.raises(warc.BadArchive):
            warc.parsed(bad)


def test_frames_are_read_in_chunks():
    rng = np.random.default_rng(1)
    records = [bytes(rng.integers(0, 256, int(k), np.uint8)) for k in (0, 1, 4095, 4096, 5000, 70_000, 3_000_000, 2)]
    for dictionary in (b"", zstd.train_dictionary(2000, [b"some words of a page %d" % k * 20 for k in range(200)]).as_bytes()):
        assert list(warc.frames(warc.archive(records, dictionary))) == records
    with pytest.raises(warc.BadArchive):
        list(warc.frames(struct.pack("<II", 0x184D2A5D, 8) + struct.pack("<I", 0xFD2FB528) + b"bad!"))


def test_wrong_lengths_are_refused():
    body = warc.record("response", "1", "u", warc.digest_of(b"payload"), 7, b"payload", None)
    for wrong in (body.replace(b"X-Payload-Length: 7", b"X-Payload-Length: 8"), body[:-5], body.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), b"WARC/1.1\r\n\r\n"):
        with pytest.raises(warc.BadArchive):
            warc.parsed(wrong)


# --- media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.binary(min_size=1, max_size=3).map(lambda b: b * 3000)), min_size=1, max_size=5))
def test_lzw_round_trip(streams):
    assert gif.lzw_decode(gif.lzw_encode(streams)) == streams


def _plain_decode(stream: bytes, bits: int) -> bytes:
    """Code by code, as the format describes it."""
    clear, end = 1 << bits, (1 << bits) + 1
    value = int.from_bytes(stream, "little")
    at, width, entries, last, out = 0, bits + 1, [], None, []
    while True:
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            entries, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == end:
            return b"".join(out)
        item = entries[code] if code < len(entries) else last + last[:1]
        if last is not None and len(entries) < 4096:
            entries.append(last + item[:1])
            if len(entries) == 1 << width and width < 12:
                width += 1
        out.append(item)
        last = item


def test_lzw_against_a_plain_decoder():
    rng = np.random.default_rng(2)
    for s in (bytes(rng.integers(0, 256, 50_000, np.uint8)), bytes(rng.integers(0, 3, 50_000, np.uint8)), b"x" * 40_000):
        code = gif.lzw_encode([s])[0]
        assert _plain_decode(code, 8) == s


def test_codes_of_other_sizes():
    # Four colours: clear, 1 1 1 1 as codes 1, 6 (the entry just being made), 1, end.
    bits, out = [(4, 3), (1, 3), (6, 3), (1, 3), (5, 4)], 0
    at = 0
    for code, width in bits:
        out |= code << at
        at += width
    stream = out.to_bytes((at + 7) // 8, "little")
    assert gif.lzw_decode([stream], 2) == [_plain_decode(stream, 2)] == [bytes([1, 1, 1, 1])]
    with pytest.raises(gif.BadGif):
        gif.lzw_decode([b"\xff\xff"], 8)


def test_disposal_transparency_and_palettes():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    own = np.array([[9, 9, 9], [7, 7, 7]], np.uint8)
    frames = [
        gif.Frame(np.full((2, 2), 1, np.uint8), delay=5, disposal=1),
        gif.Frame(np.array([[2, 3]], np.uint8), delay=6, disposal=3, transparent=3),
        gif.Frame(np.array([[1]], np.uint8), left=1, top=1, delay=7, disposal=2, palette=own),
        gif.Frame(np.array([[2]], np.uint8), delay=8),
    ]
    (shown,) = list(gif.read(gif.write([((2, 2), palette, frames)])))
    got = [(s.canvas.copy().tolist(), s.delay) for s in shown]
    red, green, black = [255, 0, 0], [0, 255, 0], [0, 0, 0]
    assert got == [([[red, red], [red, red]], 5), ([[green, red], [red, red]], 6), ([[red, red], [red, [7, 7, 7]]], 7), ([[green, red], [red, black]], 8)]


def _media(doc_id, text):
    body = (text or "").encode()
    payload = body.ljust(max(1, -(-len(body) // 64)) * 64, b"\0")
    return doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media(docs, odd, nothing):
    for df in (docs, odd, clashing(odd)):
        got = media.media_digests(df)
        assert rows(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == sorted((_media(r["doc_id"], r["text"]) for r in df.collect()), key=repr)
        files = {r["doc_id"]: r["media"] for r in media.as_gifs(df).collect()}
        for r in got.collect():
            assert hashlib.sha256(files[r["doc_id"]]).hexdigest() == r["media_sha256"] or r["doc_id"] is None
    assert media.media_digests(nothing).collect() == []


def test_frames(odd):
    gifs = media.as_gifs(odd)
    by = defaultdict(list)
    for r in media.frames(gifs).collect():
        by[r["doc_id"]].append(r)
    long = sorted(by[4], key=lambda r: r["frame"])
    assert len(long) > 1 and [r["start_ms"] for r in long] == [100 * k for k in range(len(long))]
    for r in long:
        assert sum(r["red"]) == sum(r["green"]) == sum(r["blue"]) == r["width"] * r["height"]


# --- pipeline


def test_pipeline(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    kept = raw
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, SF)
        assert out.columns == raw.columns
        if k < 3:
            assert not Counter(out.collect()) - Counter(kept.collect())
        kept = out
    fps = [_print(r["text"]) for r in kept.select("doc_id", "text").distinct().collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_stages_keep_columns_of_any_name(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    wide = clashing(raw).withColumns({c: F.lit(c) for c in ("lang_pred", "_letter", "component_id", "rate", "target", "_text", "a.b")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        extra = out.select(*(F.col(f"`{c}`") for c in wide.columns[len(raw.columns) :])).distinct().collect()
        assert [tuple(r) for r in extra] == [tuple(wide.columns[len(raw.columns) :])]
        assert Counter(out.select(*raw.columns).collect()) == Counter(stage(spark, raw, SF).collect())
    last = corpus_pipeline.STAGES[-1][1]
    assert Counter(last(spark, wide, SF).drop("sequence_id", "offset").collect()) == Counter(last(spark, raw, SF).drop("sequence_id", "offset").collect())


def test_pipeline_on_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        table(spark, [], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# --- what the operators share


def test_thinned_samples(spark):
    df = spark.range(20_000)
    assert 120 < shared.thinned(df, "id", 100).count() < 300
    assert shared.thinned(df, "id", 10_000).count() == 20_000
    assert sorted(shared.thinned(df, "id", 50).collect()) == sorted(shared.thinned(df.repartition(7), "id", 50).collect())


def test_passing_tables_are_deleted(spark):
    with shared.passing(spark):
        inner = shared.staged(spark.range(3), "passing")
        (path,) = {f.removeprefix("file://").rsplit("/", 1)[0] for f in inner.inputFiles()[:1]}
        kept = shared.staged(spark.range(2), "other")
        assert os.path.isdir(path) and kept.count() == 2
    assert not os.path.exists(path)
    assert shared.staged(spark.range(4), "later").count() == 4


def test_ranks_inside_salts(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1)], "k string, v long")
    ranked = shared.salted(df, ["k"], ["v"], F.pmod(F.xxhash64("v"), F.lit(7)))
    offsets = shared.salt_offsets(ranked.groupBy("k", "_salt").agg(F.count("*").alias("n")), ["k"])
    places = ranked.join(offsets, ["k", "_salt"]).select("k", (F.col("_off") + F.col("_nth")).alias("p")).collect()
    assert sorted(r["p"] for r in places if r["k"] == "a") == list(range(500))
