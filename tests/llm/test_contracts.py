"""Every registered query on a whole table, its columns as promised, against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from kithgraph.llm import media
from kithgraph.llm.queries import QUERIES
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, SF, clashing, table
from tests.llm.test_groups import PAGES, WORD, _classes, _media, _pages, _print, _targets
from tests.llm.test_packing import _check
from tests.llm.test_texts import _rules

LETTER = __import__("regex").compile(r"\p{L}")


def _crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


@pytest.fixture(scope="module", params=["given", "odd"])
def at(request, spark, tmp_path_factory):
    """A folder with the given tables, or with odd rows and columns besides them."""
    if request.param == "given":
        return SF
    path = str(tmp_path_factory.mktemp("odd"))
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 1000)
    wide = clashing(given.unionByName(table(spark, ODD))).withColumns({c: F.lit(c) for c in ("_h", "row", "cluster", "vertex", "held_out", "fingerprint")})
    wide.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    labels.unionByName(table(spark, [(None, 1, 0), (5, 1, 0), (5, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int").select(*(F.col(c).cast(labels.schema[c].dataType) for c in labels.columns))).write.parquet(f"{path}/labels.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = table(spark, [(None, None, None), (None, "u", "x"), (1_000_001, "u", None), (1_000_002, None, "x"), (1_000_002, "other", "x"), (1_000_003, "v", "")], PAGES)
    pages.unionByName(odd.select(*(F.col(c).cast(pages.schema[c].dataType) for c in pages.columns))).withColumns({"digest": F.lit(1), "payload": F.lit("p"), "n": F.lit(2)}).write.parquet(f"{path}/pages.parquet")
    return path


def _docs(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet").collect()


def _types(df) -> dict[str, str]:
    return dict(df.dtypes)


def test_op1(spark, at):
    df = QUERIES["op1_best_fit_packing"](spark, at).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert _types(df) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    _check(df.collect(), [(r["doc_id"], r["text"]) for r in _docs(spark, at)])


def test_op3(spark, at):
    df = QUERIES["op3_gif_media"](spark, at)
    docs = _docs(spark, at)
    got = df.collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in got) == Counter(_media(r["doc_id"], r["text"]) for r in docs)
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    by = {r["doc_id"]: r for r in got}
    for r in docs[:20]:
        body = (r["text"] or "").encode()
        file = media.stored([body.ljust(max(1, -(-len(body) // 64)) * 64, b"\0")])[0]
        if r["doc_id"] in by and r["doc_id"] != 5:
            assert (by[r["doc_id"]]["media_bytes"], by[r["doc_id"]]["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())


def test_op4(spark, at):
    df = QUERIES["op4_entropy_mixing"](spark, at)
    got, docs = df.collect(), _docs(spark, at)
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    total, longest = Counter(), defaultdict(int)
    for r in docs:
        n = len(WORD.findall(r["text"] or ""))
        total[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    target = _targets(dict(total))
    source = {r["doc_id"]: r["source"] for r in docs}
    taken = Counter()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    for r in got:
        if r["doc_id"] is not None:
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
            assert r["target"] == pytest.approx(target[source[r["doc_id"]]], abs=1e-6)
            taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    ambiguous = {r["source"] for r in docs if r["doc_id"] is None}
    for s in total:
        if s not in ambiguous:
            assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = QUERIES["op4_entropy_mixing"](spark, at).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def test_op5(spark, at):
    got, docs = QUERIES["op5_language_id"](spark, at).collect(), _docs(spark, at)
    learnt = {r["lang"] for r in docs if r["lang"] is not None and _crc(r["doc_id"]) % 5}
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    known = {(r["doc_id"], bool(LETTER.search(r["text"] or ""))) for r in docs}
    for r in got:
        assert r["held_out"] == (_crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learnt or (r["lang_pred"] == "und" and (r["doc_id"], False) in known)


def test_op6(spark, at):
    got, docs = QUERIES["op6_simhash"](spark, at).collect(), _docs(spark, at)
    fp = [_print(r["text"]) for r in docs]
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(docs, fp, _classes(fp, [r["doc_id"] for r in docs]), strict=True))
    assert Counter(tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in got) == want


def test_op8(spark, at):
    got, docs = QUERIES["op8_quality_classifier"](spark, at).collect(), _docs(spark, at)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    for r in got:
        assert r["held_out"] == (_crc(r["doc_id"]) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9(spark, at):
    got, docs = QUERIES["op9_quality_rules"](spark, at).collect(), _docs(spark, at)
    want = Counter()
    for r in docs:
        base = _rules(r["text"])
        want[(r["doc_id"], *base, base[0] < 20 or 100 * base[4] > 30 * base[0])] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op10(spark, at):
    df = QUERIES["op10_zstd_warc"](spark, at)
    pages = spark.read.parquet(f"{at}/pages.parquet")
    assert _types(df)["page_id"] == _types(df)["refers_to"] == _types(pages)["page_id"]
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()]
    assert sorted(got, key=repr) == _pages([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
