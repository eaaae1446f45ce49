"""Kernels against plain Python, builds and their gates, tables that change, and life cycles."""

from __future__ import annotations

import json
import tracemalloc
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kithgraph.functions import cursors
from kithgraph.operators import communities, explore, integrity, layout, louvain, octree, relational, search
from kithgraph.plans import catalog, publish, revisions
from kithgraph.plans.queries import QUERIES
from kithgraph.plans.staging import shared_dir, staged
from kithgraph.sources import exports, workspace
from kithgraph.sources.corpus import Corpus
from kithgraph.streaming import incremental, lifecycle
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _cliques(n, size):
    edges = [(f"c{k}n{i}", f"c{k}n{j}", 1.0) for k in range(n) for i, j in combinations(range(size), 2)]
    return edges + [(f"c{k}n0", f"c{(k + 1) % n}n0", 1.0) for k in range(n)]


# --- Louvain


def _plain_pass(ids, links):
    """The older rule, written out: unit weights, sorted ids, ascending candidates, the community left counts the node."""
    near = {x: Counter() for x in ids}
    for u, v in links:
        if u in near and v in near:
            near[u][v] += 1
            near[v][u] += 1
    degree = {x: sum(a.values()) for x, a in near.items()}
    m2 = sum(degree.values())
    at = {x: k for k, x in enumerate(ids)}
    held = Counter({k: degree[x] for k, x in enumerate(ids)})
    for _ in range(50):
        moved = False
        for x in sorted(ids):
            own = at[x]
            to = Counter()
            for y, w in near[x].items():
                to[at[y]] += w
            best, gain = own, 0
            for c in sorted(to):
                # Times m2 squared, in whole numbers.
                g = (to[c] - to[own]) * m2 - degree[x] * (held[c] - held[own])
                if c != own and g > gain:
                    best, gain = c, g
            if best != own:
                held[own] -= degree[x]
                held[best] += degree[x]
                at[x], moved = best, True
        if not moved:
            break
    names = {c: k for k, c in enumerate(sorted(set(at.values())))}
    return {x: names[c] for x, c in at.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 14), st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13)), max_size=40))
def test_flat_pass_is_the_rule_written_out(n, pairs):
    ids = [f"n{k}" for k in range(n)][::-1]
    links = [(f"n{a}", f"n{b}") for a, b in pairs if a != b]
    assert louvain.flat(ids, links)[0] == _plain_pass(ids, links)


def test_flat_pass_finds_planted_communities():
    edges = [(u, v) for u, v, _ in _cliques(5, 6)]
    ids = sorted({x for e in edges for x in e})
    found, q = louvain.flat(ids, edges)
    assert len(set(found.values())) == 5 and q > 0.6
    assert all(len({found[f"c{k}n{i}"] for i in range(6)}) == 1 for k in range(5))


def test_nested_levels():
    edges = [(u, v) for u, v, _ in _cliques(8, 5)]
    ids = sorted({x for e in edges for x in e})
    levels = louvain.nested(ids, edges)
    assert [x.level for x in levels] == list(range(len(levels))) and set(levels[0].community.values()) == set(range(40))
    assert len(set(levels[1].community.values())) == 8 and all(v is None for v in levels[1].finer.values())
    for fine, coarse in zip(levels[1:], levels[2:], strict=False):  # every community lies in one of the next level
        assert len({(fine.community[x], coarse.community[x]) for x in ids}) == len(set(fine.community.values()))
    assert set(levels[-1].community.values()) == {0}
    single = louvain.nested(ids, edges, doubled=False)
    assert len(set(single[2].community.values())) <= len(set(levels[2].community.values()))
    assert louvain.nested([], []) and len(louvain.nested(["a"], [])) == 1


def _q(edges, label, resolution):
    degree, inner, m2 = Counter(), 0.0, 0.0
    for u, v, w in edges:
        degree[u] += w
        degree[v] += w
        m2 += 2 * w
        inner += 2 * w * (label[u] == label[v])
    by = defaultdict(float)
    for x, d in degree.items():
        by[label[x]] += d
    return inner / m2 - resolution * sum(d * d for d in by.values()) / m2**2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 5)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 5)), min_size=1, max_size=40), st.sampled_from([0.5, 1.0, 2.0]))
def test_multilayer_modularity(a, b, resolution):
    layers = [[(u, v, float(w)) for u, v, w in x if u != v] for x in (a, b)]
    if not all(layers):
        return
    levels, q = louvain.multilevel(layers, [0.7, 0.3], resolution)
    names = levels[-1]
    assert q == pytest.approx(sum(w * _q(x, names, resolution) for w, x in zip((0.7, 0.3), layers, strict=True)))
    alone = {x: k for k, x in enumerate(names)}
    assert q >= sum(w * _q(x, alone, resolution) for w, x in zip((0.7, 0.3), layers, strict=True)) - 1e-9
    assert louvain.multilevel([x[::-1] for x in layers], [0.7, 0.3], resolution)[0] == levels


def test_layers_decide_together(spark):
    """What one layer leaves open the other decides."""
    cliques = _cliques(4, 5)
    rows = [("a", u, v, w, 0.5) for u, v, w in cliques] + [("b", f"c{k}n0", f"c{k + 1}n0", 40.0, 0.5) for k in (0, 2)] + [("b", "c0n1", "c0n1", 9.0, 0.5), ("b", "c0n1", "c3n1", 0.0, 0.5)]
    layers = spark.createDataFrame(rows, "layer string, u string, v string, raw double, weight double")
    found = {r["id"]: r["community_id"] for r in communities.multiplex_partitions(layers, [0.5]).collect()}
    assert found["c0n0"] == found["c1n0"] and found["c2n0"] == found["c3n0"] and found["c0n0"] != found["c2n0"]
    best = communities.fine_selection(communities.multiplex_partitions(layers.where("layer = 'a'"), [0.5, 1.0, 50.0]))
    assert Counter(r["community_id"] for r in best.collect()) == dict.fromkeys(range(4), 5)
    assert communities.fine_selection(communities.multiplex_partitions(layers.where("layer = 'a'"), [50.0])).isEmpty()


def test_vertices_with_nothing_new_around_are_passed_over():
    """partitions are what full sweeps give, with fewer looks at vertices than sweeps times vertices."""
    rng, looks = np.random.default_rng(8), 0

    class Counted(dict):
        def items(self):
            nonlocal looks
            looks += 1
            return super().items()

    for own_counts in (False, True):
        edges = [(int(u), int(v), float(w)) for u, v, w in zip(*rng.integers(0, 400, (2, 1600)), rng.random(1600), strict=True) if u != v]
        layer = louvain.layer_of({x: x for x in range(400)}, edges)
        layer.around = [Counted(a) for a in layer.around]
        looks, sweeps = 0, 0
        found = louvain.moved([layer], [1.0], 1.0, list(range(400)), own_counts)
        made = looks

        # Full sweeps: one at a time, each from where the one before ended, until none moves.
        label, held = list(range(400)), layer.degree.copy()
        for sweeps in range(1, louvain.SWEEPS + 1):
            before = label.copy()
            for i in range(400):
                links = defaultdict(float)
                for j, w in layer.around[i].items():
                    links[label[j]] += w
                own, d, best, gain = label[i], layer.degree[i], label[i], 0.0
                stay = links.get(own, 0.0) - d * (held[own] - (0.0 if own_counts else d)) / layer.total
                for c in sorted(links):
                    if c != own and (links[c] - d * held[c] / layer.total - stay) / layer.total > gain + louvain.NOTHING:
                        best, gain = c, (links[c] - d * held[c] / layer.total - stay) / layer.total
                held[own] -= d
                held[best] += d
                label[i] = best
            if label == before:
                break
        assert found == label and made < 0.8 * sweeps * 400


def test_large_graphs_are_merged_first(spark):
    links = spark.createDataFrame(_cliques(12, 6), "u string, v string, weight double")
    whole = {r["id"]: r["community_id"] for r in communities.hierarchy(links, [1.0]).where("level = 1").collect()}
    rows = communities.hierarchy(links, [1.0], most=50).where("level = 1").collect()
    part = {r["id"]: r["community_id"] for r in rows}
    assert set(part) == set(whole) and _q(_cliques(12, 6), part, 1.0) > 0.6
    assert all(len({part[f"c{k}n{i}"] for i in range(6)}) == 1 for k in range(12))


def _plain_labels(edges, sweeps=100):
    near = defaultdict(list)
    for u, v, w in edges:
        if u != v:
            near[u].append((v, w))
            near[v].append((u, w))
    label = {x: x for x in near}
    for _ in range(sweeps):
        new = {}
        for x, around in near.items():
            votes = Counter({label[x]: 1})
            for y, w in around:
                votes[label[y]] += w
            new[x] = min(votes, key=lambda c: (-votes[c], c))
        if new == label:
            break
        label = new
    return label


def test_label_propagation_is_the_rule_written_out(spark):
    rng = np.random.default_rng(4)
    edges = [(f"n{a}", f"n{b}", int(w)) for a, b, w in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.integers(1, 4, 60), strict=True)]
    for some, sweeps in ((edges, 100), (edges, 3), ([(f"p{k}", f"p{k + 1}", 1) for k in range(12)], 100)):
        links = spark.createDataFrame(some, "u string, v string, weight long")
        assert dict(communities.label_propagation(links, sweeps=sweeps).collect()) == _plain_labels(some, sweeps)


# --- layouts


@pytest.mark.parametrize("dimensions", [2, 3])
def test_trees_give_all_pairs(dimensions):
    rng = np.random.default_rng(dimensions)
    pos = rng.normal(size=(300, dimensions))
    pos[:6] = pos[6]  # bodies on one spot
    mass = rng.random(300) + 0.5
    d = pos[:, None] - pos[None]
    r2 = np.maximum((d * d).sum(axis=2), 1e-6)
    for power in (1, 2):
        pairs = 3.0 * mass[:, None] * ((mass[None] / r2 ** ((power + 1) / 2))[:, :, None] * d).sum(axis=1)
        assert np.allclose(octree.repulsion(pos, mass, 3.0, power, 0.0), pairs, rtol=1e-6, atol=1e-5)
        near = octree.repulsion(pos, mass, 3.0, power, 0.5)
        assert np.linalg.norm(near - pairs) < 0.05 * np.linalg.norm(pairs)
    assert octree.repulsion(np.zeros((1, dimensions)), np.ones(1)).tolist() == [[0.0] * dimensions]
    assert octree.Tree(np.zeros((9, dimensions)), np.ones(9)).cells() > 0


def test_pins_stay_and_warm_starts_are_used(spark):
    nodes = spark.createDataFrame([(f"c{k}n{i}", str(10 * k + i), float(k), float(i), 1.0 + i, k == 0) for k in range(3) for i in range(6)], "id string, val string, pos_x double, pos_y double, pos_z double, pinned boolean")
    edges = spark.createDataFrame(_cliques(3, 6), "u string, v string, weight double")
    placed = layout.layout(nodes, edges, "world", 30).toPandas().set_index("id")
    for i in range(6):
        assert placed.loc[f"c0n{i}"].tolist() == [0.0, float(i), 1.0 + i]
    assert not np.allclose(placed.loc["c1n0"], [1.0, 0.0, 1.0])
    still = layout.layout(nodes.drop("pinned"), edges.limit(0), "spring", 30).toPandas().set_index("id")
    assert still.loc["c2n3"].tolist() == [2.0, 3.0, 4.0]  # nothing to pull, nothing moves


def test_layouts_of_more_bodies_than_they_move(spark):
    nodes = spark.createDataFrame([(f"c{k}n{i}", str(10 * k + i)) for k in range(3) for i in range(6)], "id string, val string")
    edges = spark.createDataFrame(_cliques(3, 6), "u string, v string, weight double")
    for kind in ("spring", "world"):
        found = layout.layout(nodes, edges, kind, 10, most=7).toPandas().set_index("id")
        assert len(found) == 18 and np.isfinite(found.to_numpy()).all()


def test_groups_of_bodies_walk_a_tree():
    """every body is in one group of few, also where many lie on one spot, and these push the rest as one."""
    rng = np.random.default_rng(4)
    pos = np.concatenate([rng.normal(size=(700, 3)), np.zeros((300, 3))])
    first, last = octree.Tree(pos, np.ones(1000))._groups()
    assert first[0] == 0 and last[-1] == 1000 and (first[1:] == last[:-1]).all() and (last - first).max() <= octree.GROUP and len(first) < 300
    d = pos[:, None] - pos[None]
    pairs = (d / np.maximum((d * d).sum(axis=2), 1e-6)[:, :, None]).sum(axis=1)
    for theta, most in ((0.0, 1e-4), (0.8, 0.05)):
        assert np.linalg.norm(octree.repulsion(pos, np.ones(1000), theta=theta) - pairs) < most * np.linalg.norm(pairs)


def test_memory_of_a_layout_does_not_grow_with_its_links():
    """links are taken in runs, and give what all of them at once give."""
    rng = np.random.default_rng(3)
    u, v = np.triu_indices(600, 1)
    w = rng.random(len(u), np.float32)
    tracemalloc.start()
    layout.world_layout([f"c{k}" for k in range(600)], u.astype(np.int32), v.astype(np.int32), w, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    pos, move, want = rng.normal(size=(600, 3)), np.zeros((600, 3)), np.zeros((600, 3))
    layout._attract(pos, u, v, lambda r, at: w[at] / r, move)
    d = pos[u] - pos[v]
    pull = d * (w / np.sqrt((d * d).sum(axis=1)))[:, None]
    np.add.at(want, v, pull)
    np.add.at(want, u, -pull)
    assert np.allclose(move, want, rtol=1e-4, atol=1e-3)


def test_full_tiles_of_links_pull_as_links_do():
    """where most bodies are linked, links are matrices, and these pull like each link alone, also beside a few loose links."""
    rng = np.random.default_rng(5)
    u, v = np.triu_indices(600, 1)
    some = rng.random(len(u)) < 0.8
    u, v = np.append(u[some], np.arange(600, 899)), np.append(v[some], np.arange(601, 900))
    pull, pos, k = rng.random(len(u)).astype(np.float32), 40 * rng.normal(size=(900, 3)), 3.0
    pos[7] = pos[8]
    pulls = layout.Pulls(900, u, v, pull, np.ones(900, bool))
    assert len(pulls.at) and 299 <= len(pulls.u) < len(u) / 2
    move, want, d = np.zeros((900, 3)), np.zeros((900, 3)), pos[v] - pos[u]
    pulls.move(pos, k, move)
    r = np.maximum(np.sqrt((d * d).sum(axis=1)), 1e-9)
    np.add.at(want, u, d * (pull * np.log1p(r / k) / r)[:, None])
    np.add.at(want, v, -d * (pull * np.log1p(r / k) / r)[:, None])
    assert np.allclose(move, want, rtol=1e-4, atol=1e-3)


def test_what_is_pinned_takes_no_sums():
    """forces are summed for free bodies only, and are what they are among all; links between pins are left out."""
    rng = np.random.default_rng(6)
    pos, mass, free = rng.normal(size=(2000, 3)), rng.random(2000) + 0.5, np.arange(2000) % 3 == 0
    d = pos[free][:, None] - pos[None]
    pairs = mass[free][:, None] * ((mass[None] / np.maximum((d * d).sum(axis=2), 1e-6))[:, :, None] * d).sum(axis=1)
    for theta, most in ((0.0, 1e-6), (0.8, 0.05)):
        found = octree.repulsion(pos, mass, theta=theta, free=free)
        assert not found[~free].any() and np.linalg.norm(found[free] - pairs) < most * np.linalg.norm(pairs)
    u, v = np.arange(1999), np.arange(1, 2000)
    assert len(layout.Pulls(2000, u, v, np.ones(1999, np.float32), free).u) == (free[u] | free[v]).sum()
    start = pos.copy()
    start[~free] *= 100
    start[3] = start[0]  # two free bodies on one spot
    found = layout.world_layout([f"n{k}" for k in range(2000)], u, v, np.ones(1999), 5, start=start, pinned=~free)
    assert (found[~free] == start[~free]).all() and np.isfinite(found).all() and (found[0] != found[3]).any()


def test_spectral_positions_split_a_group(spark):
    """Two tight halves of a group come to lie on either side of its middle."""
    half = [(a, b, 1.0) for lo in (0, 4) for a, b in combinations(range(lo, lo + 4), 2)] + [(3, 4, 0.05)]
    members = spark.createDataFrame([(k, 1) for k in range(8)] + [(9, 2)], "id long, group_id long")
    found = {r["id"]: r["position"] for r in layout.spectral(spark.createDataFrame(half, "u long, v long, affinity double"), members).collect()}
    assert max(abs(found[k]) for k in range(8)) == pytest.approx(1) and found[0] > 0
    assert len({np.sign(found[k]) for k in range(4)}) == 1 and np.sign(found[0]) != np.sign(found[7])
    assert found[9] == 0


# --- reads


def test_author_links_of_many_posts(spark):
    """Like all pairs of an author's posts, ranked."""
    rng = np.random.default_rng(2)
    posts = [(k, int(rng.integers(0, 3)), int(rng.choice([0, 0, 0, 0, 1, 2, 3]))) for k in range(120)]
    df = spark.createDataFrame(posts, "id long, author_id long, community_id long")
    for cap in (1, 3, 50):
        want = {(a, b) for a, x, c in posts for b in sorted(b for b, y, d in posts if x == y and c != d)[:cap]}
        got = {tuple(int(v.split("_")[1]) for v in r) for r in relational.author_cross_links(df, cap).collect()}
        assert got == want


def test_top_links_lose_none(spark):
    links = spark.createDataFrame([("hub", f"n{k}", 100 - k) for k in range(40)] + [("a", "b", 70), ("a", "hidden", 999)], "source string, target string, weight long")
    shown = spark.createDataFrame([("hub",), ("a",), ("b",), *[(f"n{k}",) for k in range(40)]], "id string")
    got = [tuple(r) for r in search.lateral_top_links(links, shown, 20).collect()]
    assert got == [("hub", f"n{k}", 100 - k) for k in range(20)]


def test_two_threads_at_once(spark):
    rows = [spark.createDataFrame([(f"{x}{k}", x if k == 0 else f"{x}{k - 1}", k) for k in range(5)], "id string, parent_id string, value long") for x in "ab"]
    plans = [search.thread(df, x, 3, 10) for df, x in zip(rows, "ab", strict=True)]
    assert [[r["id"] for r in p.collect()] for p in plans] == [["a0", "a1", "a2"], ["b0", "b1", "b2"]]


def test_versions_that_are_gone(spark):
    versions = spark.createDataFrame([(k, "completed") for k in range(5, 9)], "id long, status string")
    diffs = spark.createDataFrame([(k, "node", "add") for k in range(5, 9)], "version_id long, entity_type string, action string")
    assert explore.version_diff(diffs, versions, 6).collect() == [("node", "add", 2)]
    with pytest.raises(explore.Gone):
        explore.version_diff(diffs, versions, 2)
    with pytest.raises(ValueError, match="not yet"):
        explore.version_diff(diffs, versions, 9)


def test_pinned_cursors():
    token = cursors.pin("region", 10, revision=1, catalog=2)
    assert cursors.pinned("region", token, revision=1, catalog=2) == 10 and cursors.pinned("region", None, revision=9) == 0
    for kind, where in (("region", {"revision": 2, "catalog": 2}), ("entity", {"revision": 1, "catalog": 2})):
        with pytest.raises(cursors.Moved):
            cursors.pinned(kind, token, **where)
    for bad in ("x", cursors.pin("region", -1, revision=1)):
        with pytest.raises(cursors.BadCursor):
            cursors.pinned("region", bad, revision=1)


# --- tables that change


def test_versions_of_a_table(spark, tmp_path, monkeypatch):
    space = workspace.Workspace(spark, f"file://{tmp_path}")
    with pytest.raises(LookupError):
        space.read("t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert space.replace("t", rows) == 1
    held = space.read("t")
    space.upsert("t", spark.createDataFrame([(2, "B"), (3, "c"), (3, "C")], "id long, v string"), ["id"], order=F.col("v"))
    assert sorted(map(tuple, space.read("t").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert held.count() == 2  # a reader keeps the version that it began with
    monkeypatch.setattr(workspace.Workspace, "versions", lambda self, table: [1])  # another writer was faster
    with pytest.raises(workspace.Conflict):
        space.replace("t", rows)


def test_touched_rows(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, v string, at timestamp").withColumn("at", F.when(F.col("id") == 1, F.lit("2020-01-01").cast("timestamp")))
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id long, v string")
    got = {r["id"]: (r["v"], str(r["at"])[:4]) for r in workspace.upserted(old, new, ["id"], "at", "2024-05-05").collect()}
    assert got == {1: ("a", "2020"), 2: ("c", "2024"), 3: ("d", "2024")}


def test_a_pointer_is_never_absent(spark, tmp_path, monkeypatch):
    """A crash before the last rename leaves the revision before published."""
    store = publish.Store(spark, f"file://{tmp_path}")
    store.publish({"t": spark.range(3)})
    before = store.current()
    real = publish.Store._pointers
    crashed = {}

    def crash(self):
        crashed["published"] = [p for p in tmp_path.iterdir() if p.name.startswith("current-")]
        raise RuntimeError("lost")

    monkeypatch.setattr(publish.Store, "_pointers", crash)
    with pytest.raises(RuntimeError, match="lost"):
        store.publish({"t": spark.range(5)})
    monkeypatch.setattr(publish.Store, "_pointers", real)
    assert len(crashed["published"]) == 1 and store.current() == before and store.read("t").count() == 3
    for n in range(12):
        store.publish({"t": spark.range(n + 1)})
    assert store.read("t").count() == 12 and len(store._pointers()) <= 9
    monkeypatch.setattr(publish.Store, "_pointers", lambda self: real(self)[:-1])  # another publication took the next number
    with pytest.raises(publish.Rejected):
        store._point(before)


def test_staging_sets_nothing_and_cuts_lineage(spark):
    before = spark.sparkContext.getCheckpointDir()
    df = staged(spark.range(5).withColumn("x", F.rand()), "staged")
    assert df.collect() == df.collect() and "rand" not in df._jdf.queryExecution().toString()
    assert spark.sparkContext.getCheckpointDir() == before and shared_dir(spark).startswith("file:")


# --- builds


def test_a_catalog_and_its_revision(spark, tmp_path):
    c = Corpus(spark, SF)
    built = revisions.build_catalog(c, "1998-08-01", rounds=5)
    assert built.report.first()["passed"]
    again = revisions.build_catalog(c, "1998-08-01", rounds=5, previous=built)
    kinds = {r["provenance"] for r in again.entities.select("provenance").distinct().collect()}
    assert kinds == {"warm-start"}
    a, b = (x.entities.select("id", *(F.round(f"pos_{k}", 6) for k in "xyz")) for x in (built, again))
    assert a.exceptAll(b).isEmpty()
    groups = c.communities.select(F.concat(F.lit("community_"), "id").alias("id"), F.col("nation").cast("string").alias("group_id"))
    caps = {"community": 50, "user": 50, "post": 0, "comment": 0}
    first = revisions.build_revision(built, groups, c.activity, c.relationships, caps=caps, most_nodes=80, most_links=300)
    assert first.summary.first()["passed"]
    store = publish.Store(spark, f"file://{tmp_path}/r")
    revisions.publish_revision(store, first, keep=1)
    second = revisions.build_revision(built, groups, c.activity, c.relationships, previous=first, moved=True, caps=caps, most_nodes=80, most_links=300)
    old = {r["community_id"]: r for r in first.communities.collect()}
    for r in second.communities.collect():
        assert r["community_id"] in old and r["label"] == old[r["community_id"]]["label"]
    nothing = revisions.build_revision(built, groups, c.activity, c.relationships, caps=caps | {"community": 1, "user": 0}, most_nodes=1, most_links=300)
    with pytest.raises(publish.Rejected, match="valid"):
        revisions.publish_revision(store, nothing)
    assert store.read("nodes").count() == first.nodes.count()
    with pytest.raises(ValueError, match="caps"):
        revisions.build_revision(built, groups, c.activity, c.relationships, most_nodes=0)


def test_links_of_a_revision_come_from_its_entities(spark):
    """what entities name meets the nodes at once; the catalog's links, checked against all entities, are not made for it."""
    c = Corpus(spark, SF)
    built = revisions.build_catalog(c, "1998-08-01", rounds=2)
    groups = c.communities.select(F.concat(F.lit("community_"), "id").alias("id"), F.col("nation").cast("string").alias("group_id"))
    caps = {"community": 50, "user": 50, "post": 50, "comment": 50}
    nodes = revisions.selected_nodes(built.entities, caps, 200)
    want = revisions.projected_links(nodes, c.activity, c.relationships, built.links, caps, 5000)
    unread = replace(built, links=built.links.withColumn("relation", F.raise_error(F.lit("read")).cast("string")))
    found = revisions.build_revision(unread, groups, c.activity, c.relationships, caps=caps, most_nodes=200, most_links=5000).links
    assert {"authorship", "published_in"} <= {r["relation"] for r in found.select("relation").distinct().collect()}
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def _shown(spark, groups, each, fallback=0.0):
    n = groups * each
    return spark.createDataFrame([(k, f"m{k % groups}", 10 + k, 0.5, 0.5, False, k < fallback * n) for k in range(n)], "community_id long, macro_id string, size long, distinctiveness double, confidence double, is_bridge boolean, fallback boolean")


@pytest.mark.parametrize(("groups", "each", "fallback", "passes"), [(8, 5, 0.0, True), (12, 6, 0.0, True), (7, 9, 0.0, False), (13, 5, 0.0, False), (9, 4, 0.0, False), (10, 10, 0.06, False), (10, 10, 0.04, True)])
def test_promotion_gates(spark, groups, each, fallback, passes):
    assert revisions.promotion_gates(_shown(spark, groups, each, fallback)).first()["passed"] is passes


def test_an_affinity_build_is_promoted(spark, tmp_path):
    """Ninety communities in nine groups of ten cliques, from users to a published revision."""
    rng = np.random.default_rng(1)
    active = []
    for g in range(9):
        for k in range(10):
            for u in range(12):
                active += [(g * 1000 + k * 50 + u, g * 100 + k * 6 + int(c), 3) for c in rng.choice(6, 4, replace=False)]
        for u in range(40):
            active += [(g * 1000 + 700 + u, g * 100 + int(c), 2) for c in rng.choice(60, 3, replace=False)]
    for u in range(9):
        active += [(99_000 + u, u * 100, 1), (99_000 + u, (u + 1) % 9 * 100, 1)]
    act = spark.createDataFrame(active, "user_id long, community_id long, activity_count long").groupBy("user_id", "community_id").agg(F.sum("activity_count").alias("activity_count"))
    posts = act.select(F.col("user_id").alias("author_id"), "community_id").sample(1.0)
    cross = spark.createDataFrame([], "post_id long, source long, target long, observed_at timestamp")
    ids = act.select(F.col("community_id").alias("id")).distinct()

    class Made:
        activity, cross_references = act, cross
        communities = ids.select("id", F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"), F.lit(5).alias("subscribers"))

    Made.posts = posts
    build = revisions.build_affinity(Made, "w1")
    gates = revisions.promotion_gates(build.communities).first()
    assert 8 <= gates["n_groups"] <= 12 and len(build.identities) == gates["n_groups"]
    assert len({v["role"] for v in build.identities.values()}) == gates["n_groups"]
    whole = ids.select(F.concat(F.lit("community_"), "id").alias("id"), F.lit("L").alias("label"), F.lit("community").alias("type"), F.col("id").alias("value"), *((F.col("id") * k % 97).cast("double").alias(f"pos_{a}") for k, a in ((3, "x"), (5, "y"), (7, "z"))), F.lit("x").alias("provenance"))
    none = spark.createDataFrame([], "source string, target string, relation string, directed boolean, weight long")
    built = revisions.Catalog(whole, whole.limit(0), none, whole.limit(0), whole.limit(0), whole.limit(0), "w1")
    store = publish.Store(spark, f"file://{tmp_path}/p")
    related = relational.overlaps(act, 2)
    if gates["passed"]:
        revisions.promote(store, built, build, act, related)
        assert store.read("nodes").count() == ids.count() and store.read("presented").count() == build.communities.count()
    else:
        with pytest.raises(publish.Rejected, match="promotion"):
            revisions.promote(store, built, build, act, related)
    built.watermark = "w2"
    with pytest.raises(publish.Rejected, match="catalog"):
        revisions.promote(store, built, build, act, related)


def test_identities_by_subscribers(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, group_id string")
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, group_id string")
    assert publish.stable_ids(old, new).first()["stable_id"] == "x"
    big = spark.createDataFrame([("c", 1_000_000)], "id string, subscribers long")
    assert publish.stable_ids(old, new, big).first()["stable_id"] == "y"
    fresh = publish.stable_ids(old.limit(0), new).first()["stable_id"]
    assert fresh.startswith("c:new:") and fresh == publish.stable_ids(old.limit(0), new.repartition(3)).first()["stable_id"]
    assert fresh != publish.stable_ids(old.limit(0), new.where("id <> 'a'")).first()["stable_id"]


def test_a_batch_of_a_delete_is_not_cut_in_one_task(spark):
    """the smallest keys in their order, over parts of any size, without a limit in the plan."""
    rows = spark.range(2000).select(F.format_string("%04d", F.col("id")).alias("id")).repartition(7)
    orphans = rows.where("id % 2 = 0")
    for batch in (1, 399, 1000, 5000):
        gone, rest = integrity.deleted_in_batches(rows, orphans, ["id"], batch)
        assert sorted(r[0] for r in gone.collect()) == [f"{2 * k:04}" for k in range(min(batch, 1000))]
        assert gone.count() + rest.count() == 2000
        assert "Limit" not in gone._jdf.queryExecution().toString()


def test_a_document_in_pieces(spark):
    """joined pieces are the whole document, and none is larger than asked for."""
    nodes = spark.createDataFrame([(f"n{k:02}", 'a "name"', str(k), "user") for k in range(25)], "id string, name string, val string, type string")
    links = spark.createDataFrame([(f"n{k % 25:02}", f"n{k % 7:02}") for k in range(40)], "source string, target string")
    whole = json.loads(exports.graph_json(nodes, links).first()["document"])
    pieces = exports.graph_json_pieces(nodes.repartition(5), links.repartition(3), 4).orderBy("kind", "place").collect()
    assert max(len(json.loads(r["piece"])) for r in pieces) == 4
    assert {k: [x for r in pieces if r["kind"] == k for x in json.loads(r["piece"])] for k in ("nodes", "links")} == whole
    assert exports.graph_json_pieces(nodes.limit(0), links.limit(0)).isEmpty()


# --- life cycles and streams


def _attempts(spark, rows):
    schema = "request_id long, number int, state string, worker string, started_at string, lease_expires_at string, finished_at string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "lease_expires_at", "finished_at")})


def _requests(spark, rows):
    df = spark.createDataFrame(rows, "id long, priority long, next_due_at string, enabled boolean, cohort string, last_completed_at string")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("next_due_at", "last_completed_at")})


def test_claims_in_a_row(spark):
    """Workers claim one after the other; a lost lease is retried; the last failure is permanent."""
    requests = staged(_requests(spark, [(1, 5, "2024-01-01", True, "active", None), (2, 9, "2024-01-01", True, "active", None), (3, 9, "2030-01-01", True, "active", None), (4, 9, "2024-01-01", False, "active", None)]))
    attempts = staged(_attempts(spark, []))
    taken = []
    for worker in ("w1", "w2", "w3"):
        new, attempts = lifecycle.claimed(requests, attempts, worker, "2024-01-02 00:00:00")
        attempts = staged(attempts)
        taken += [(r["request_id"], r["number"]) for r in new.collect()]
    assert taken == [(2, 0), (1, 0)]
    attempts = staged(lifecycle.renewed(attempts, 1, "w2", "2024-01-02 00:09:00"))
    attempts = staged(lifecycle.renewed(attempts, 2, "other", "2024-01-02 00:09:00"))
    new, attempts = lifecycle.claimed(requests, attempts, "w3", "2024-01-02 00:15:00")
    assert [(r["request_id"], r["number"]) for r in new.collect()] == [(2, 1)]  # the lease of w1 ran out
    attempts = staged(attempts)
    done = spark.createDataFrame([(1, "w2", "complete"), (2, "w1", "complete"), (2, "w3", "retryable_failure")], "request_id long, worker string, outcome string")
    requests, attempts = (staged(x) for x in lifecycle.finished(requests, attempts, done, "2024-01-02 00:16:00"))
    assert {(r["request_id"], r["number"]): r["state"] for r in attempts.collect()} == {(2, 0): "retryable_failure", (1, 0): "complete", (2, 1): "retryable_failure"}
    due = {r["id"]: str(r["next_due_at"])[:16] for r in requests.collect()}
    assert due[1] == "2024-01-09 00:16" and "2024-01-02 00:18" <= due[2] <= "2024-01-02 00:19"
    last = _attempts(spark, [(1, 4, "leased", "w", "2024-01-02", "2024-01-03", None)])
    out = spark.createDataFrame([(1, "w", "retryable_failure")], "request_id long, worker string, outcome string")
    assert lifecycle.finished(requests, last, out, "2024-01-02 01:00:00")[1].first()["state"] == "permanent_failure"


def test_the_backlog_is_started_slowly(spark):
    requests = _requests(spark, [(k, 1, "2024-01-01", True, "backlog", None) for k in range(5)] + [(9, 0, "2024-01-01", True, "active", None)])
    started = _attempts(spark, [(k, 0, "complete", "w", "2024-01-02 00:00:00", "2024-01-02 00:10:00", None) for k in range(2)])
    ids = lambda starts: [r["id"] for r in lifecycle.due(requests, started, "2024-01-02 00:30:00", starts=starts).collect()]
    assert ids(3) == [0, 1, 2, 3, 4, 9] and ids(2) == [9]


def test_a_new_generation_of_retries(spark):
    """Failures before the last completion don't count."""
    requests = _requests(spark, [(1, 1, "2024-01-01", True, "active", "2024-01-01 12:00:00"), (2, 1, "2024-01-01", True, "active", None)])
    failed = _attempts(spark, [(k, n, "retryable_failure", "w", "2024-01-01 06:00:00", "2024-01-01 07:00:00", None) for k in (1, 2) for n in range(5)])
    assert [(r["id"], r["number"]) for r in lifecycle.due(requests, failed, "2024-01-02").collect()] == [(1, 0)]


def test_sessions_in_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value").orderBy("ts").limit(200)
    rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, ts string, value double").json(f"{tmp_path}/in")
    counted = incremental.session_counts(stream, "30 minutes", "0 seconds")
    query = counted.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("sessions").select("user_id", "start", "n").collect()}
    want = {tuple(r) for r in incremental.session_counts(rows.withColumn("ts", F.date_trunc("second", "ts")), "30 minutes").select("user_id", "start", "n").collect()}
    assert got <= want and len(got) >= 0.8 * len(want)  # the last ones stay open until later events come


def test_periodic_application(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "user_id long").coalesce(1).write.json(f"{tmp_path}/log")
    seen = []
    query = incremental.periodic(incremental.changed_users(spark, f"{tmp_path}/log"), lambda df, n: seen.extend(r["user_id"] for r in df.collect()), f"{tmp_path}/at", "1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [1, 2]


def test_every_query_is_named_once():
    from kithgraph.plans import every

    assert set(QUERIES) == set(every.QUERIES) and set(every.ORACLE_SQL) <= set(every.QUERIES)


def test_a_revision_without_caps_leaves_nothing_out(spark):
    """publish_revision kept 400 nodes and 900 links, and no comment."""
    c = Corpus(spark, SF)
    built = revisions.build_catalog(c, "1998-08-01", rounds=2)
    groups = c.communities.select(F.concat(F.lit("community_"), "id").alias("id"), F.col("nation").cast("string").alias("group_id"))
    found = revisions.build_revision(built, groups, c.activity, c.relationships, caps=revisions.EVERY, most_nodes=None, most_links=None)
    assert found.nodes.select("id").exceptAll(built.entities.select("id")).isEmpty() and found.nodes.count() == built.entities.count()
    made = {r["relation"]: r["n"] for r in found.links.groupBy("relation").agg(F.count("*").alias("n")).collect()}
    want = {r["relation"]: r["n"] for r in built.links.groupBy("relation").agg(F.count("*").alias("n")).collect()}
    assert made.pop("user_activity") == c.activity.count() and made == want
    some = revisions.selected_nodes(built.entities, {"community": 3, "user": None, "post": 0, "comment": 0}, None)
    assert {r["type"]: r["count"] for r in some.groupBy("type").count().collect()} == {"community": 3, "user": c.users.count()}


def test_a_catalog_has_metrics(spark, tmp_path):
    """the build left out who is automated, and the metrics of all four types."""
    c = Corpus(spark, SF)
    built = revisions.build_catalog(c, "1998-08-01", rounds=2)
    store = publish.Store(spark, f"file://{tmp_path}/c")
    revisions.publish_catalog(store, built)
    found = {r["id"]: r for r in store.read("metrics").collect()}
    assert len(found) == built.entities.count()
    posts, comments = (relational.at_watermark(x, "1998-08-01") for x in (c.posts, c.comments))
    none = c.users.limit(0)
    for t, want in (("community", catalog.community_metrics(c.communities, posts, comments, none)), ("user", catalog.user_metrics(c.users, posts,
        comments)), ("post", catalog.post_metrics(posts, comments)), ("comment", catalog.comment_metrics(comments))):
        for r in want.drop("total").collect():
            assert {k: found[f"{t}_{r['id']}"][k] for k in r.asDict() if k != "id"} == {k: v for k, v in r.asDict().items() if k != "id"}


def test_metrics_leave_out_automated_users(spark):
    communities, users = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1,), (2,), (9,)], "id long")
    posts = spark.createDataFrame([(10, 1, 1), (11, 9, 1), (12, 2, 2)], "id long, author_id long, community_id long")
    comments = spark.createDataFrame([("a", 10, 2, 1, "t3_10"), ("b", 10, 9, 1, "t1_a"), ("c", 10, 1, 1, "t1_a"), ("d", 11, 1, 1, "t3_11"), ("e", 10, 1, 1, "t1_b")],
        "id string, post_id long, author_id long, community_id long, parent_id string")
    found = {r["id"]: {k: v for k, v in r.asDict().items() if k != "id" and v is not None} for r in catalog.metrics(communities, users, posts, comments,
        spark.createDataFrame([(9,)], "id long")).collect()}
    assert found["community_1"] == {"n_posts": 1, "n_comments": 3, "n_authors": 2}
    assert found["community_2"] == {"n_posts": 1, "n_comments": 0, "n_authors": 1}
    assert found["user_1"] == {"n_posts": 1, "n_comments": 2, "n_communities": 1} and found["user_9"] == {"n_posts": 0, "n_comments": 0, "n_communities": 0}
    assert found["post_10"] == {"n_comments": 3, "n_top": 1, "n_replies": 2} and found["post_11"]["n_comments"] == 0
    assert {k[8:]: v["n_replies"] for k, v in found.items() if k.startswith("comment")} == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0}


def test_layers_of_arrays_are_those_of_links():
    rng = np.random.default_rng(3)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (200, 2)) if a != b})
    w = rng.random(len(pairs))
    want = louvain.layer_of({x: x for x in range(30)}, [(u, v, float(x)) for (u, v), x in zip(pairs, w, strict=True)])
    u, v = np.array(pairs, np.int32).T
    found = louvain.layer_of_arrays(u, v, w, 30)
    assert found.around == want.around and found.degree == pytest.approx(want.degree)


def test_fine_partitions_weigh_every_link(spark, monkeypatch):
    """only 24 links of each community and a million in all were weighed."""
    from kithgraph.plans import queries_more

    seen = []
    monkeypatch.setattr(communities, "multiplex_partitions", lambda layers, r, made=communities.multiplex_partitions: seen.append(layers) or made(layers, r))
    c = Corpus(spark, "/root/testdata/sf0.01")
    assert len(queries_more._fine(c).collect()) == len(communities.FINE)
    all_pairs = queries_more._affinity(c).where("affinity > 0").select("u", "v")
    assert seen[0].select("u", "v").distinct().count() == all_pairs.count() > queries_more._layers(c).select("u", "v").distinct().count()


def test_a_delete_reads_all_rows_once(spark, monkeypatch):
    """a batch that takes all orphans joins them with the rows once, and what stays comes from the same pass."""
    rows = spark.range(60).select(F.when(F.col("id") < 50, F.col("id") % 40).alias("id"))  # with copies and nulls
    orphans = rows.where("id % 2 = 0").union(rows.where("id % 2 = 0"))
    gone, rest = integrity.deleted_in_batches(rows, orphans, ["id"], 100)
    assert sorted(r[0] for r in gone.collect()) == sorted(k % 40 for k in range(50) if k % 2 == 0)
    assert rest.count() == 35 and rest.where("id is null").count() == 10
    assert not any("Join" in str(x._jdf.queryExecution()) for x in (gone, rest))


def test_merged_layers_keep_what_is_inside(spark, monkeypatch):
    """a graph too large for a task is merged although strengths are small, and links inside groups count as loops."""
    edges = [(u, v, 0.01 * w) for u, v, w in _cliques(6, 6)]
    layers = spark.createDataFrame([(k, u, v, w, 0.5) for k in "ab" for u, v, w in edges], "layer string, u string, v string, raw double, weight double")
    monkeypatch.setattr(communities, "KERNEL_LINKS", 100)
    rows = communities.multiplex_partitions(layers, [1.0]).collect()
    found = {r["id"]: r["community_id"] for r in rows}
    assert len(found) == 36 and all(len({found[f"c{k}n{i}"] for i in range(6)}) == 1 for k in range(6))
    assert rows[0]["modularity"] == pytest.approx(_q(edges, found, 1.0))
