from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kithgraph.llm import packing, tokens
from kithgraph.llm.queries import tokenizer_path
from tests.llm.conftest import ODD, clashing


def _check(rows: list, docs: list[tuple]) -> None:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    expected = []
    for doc_id, text, *_ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(expected, key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_pieces_and_places(docs, odd):
    for df in (docs, odd, clashing(odd)):
        rows = packing.pack_documents(df, tokenizer_path()).collect()
        _check(rows, [tuple(r)[:2] for r in df.collect()])


def test_ids_come_with_pieces(odd):
    rows = packing.pack_documents(odd, tokenizer_path(), with_ids=True).collect()
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def _ids(encode, texts: list[str]) -> list[list[int]]:
    body = [t.encode() for t in texts]
    ids, bounds = encode(np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64), 2)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_are_the_library_s(monkeypatch):
    """Words of much structure, every kind of pretoken's end, special tokens, and long texts cut into parts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(6)
    morse = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    some = ["é", "漢字。", "  ", "\n\n", " \u3000x", "'s", "'ll", " don't", "123", "abc", "!!", "\t", "a'", " ' ", "😀", "<|endoftext|>"]
    odd = ["".join(rng.choice(some, int(rng.integers(1, 3000)))) for _ in range(20)]
    texts = [morse + " " + morse.translate(str.maketrans("ab", "ba")), "", "x" * 5000, *odd]
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    encode = tokens.Encoder(tokenizer_path())
    assert encode.ranked is not None and _ids(encode, texts) == want
    monkeypatch.setattr(tokens, "PART", 100)
    assert all("".join(tokens.parts(x)) == x for x in texts) and max(len(list(tokens.parts(x))) for x in texts) > 20
    assert _ids(encode, texts) == want
    encode.library = t
    assert _ids(encode, texts) == want


def test_every_character_is_split_as_the_library_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    encode = tokens.Encoder(tokenizer_path())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}b  {c}" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    for text, e in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encode.ids(text).tolist() == e.ids


def test_nothing(nothing):
    assert packing.pack_documents(nothing, tokenizer_path()).collect() == []


def test_near_the_lower_bound(docs):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 1024) * 1.01 + 1


def _fewest(lengths: list[int], capacity: int) -> int:
    """By trying everything."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in {b for b in bins if b >= lengths[k]}:
            rest = bins.copy()
            rest.remove(room)
            go(k + 1, [*rest, room - lengths[k]])
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    """What dominance fixes, together with the best packing of the rest, is as few as can be."""
    count = np.bincount(lengths, minlength=21)
    left = count.copy()
    fixed = packing.reduce_by_dominance(left, 20)
    for run in fixed:
        assert run.times > 0 and sum(w * k for w, k in run.parts) <= 20
        for w, k in run.parts:
            count[w] -= run.times * k
    assert (count == left).all() and (left >= 0).all()
    rest = [w for w in range(21) for _ in range(left[w])]
    assert sum(r.times for r in fixed) + (_fewest(rest, 20) if rest else 0) == _fewest(lengths, 20)


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_everything(seed):
    rng = np.random.default_rng(seed)
    count = np.bincount(rng.integers(1, [65, 1025, 40, 600][seed], [500, 3000, 10, 20_000][seed]), minlength=1025)
    runs = packing.plan(count)
    placed = np.zeros_like(count)
    for run in runs:
        assert sum(w * k for w, k in run.parts) <= 1024
        for w, k in run.parts:
            placed[w] += run.times * k
    assert (placed == count).all()
    table = packing.places(runs)
    for w in np.unique(table["length"]):  # ranks of a length are covered without gaps
        assert table["rank"][table["length"] == w][0] == 0


def test_fits_the_fixture():
    assert len(ODD) == 13
