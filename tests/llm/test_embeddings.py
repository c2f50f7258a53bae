"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import embedding_dedup as ed


def all_pairs(rows, cosine=0.98):
    def unit(v, label, i):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v, label, i) for i, v, label in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine
    ]
    root = brute.roots(len(rows), links)
    least, n = {}, [0] * len(rows)
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    for r, (i, _, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, k, least.get(r), i == least.get(r)) for (i, _, _), k, r in zip(rows, n, root, strict=True)]


@pytest.mark.parametrize("shard", [2048, 60])
def test_near_duplicates(spark, shard):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.6])).tolist(), int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(30)] + [(500, rows[0][1], None), (501, None, 1), (502, [0.0] * 16, 1), (503, [], 1)]
    rows += [(504, [None] + [1.0] * 15, 1), (505, [float("nan")] * 16, 1), (506, [float("inf")] * 16, 1), (None, rows[7][1], 1), (5, rows[5][1], 2), (7, rows[8][1], 2)]
    rows += [(507, [1e300] * 16, 0), (508, [1e-300] * 16, 0), (509, [1.0] * 8, 0), (510, [3e-5] * 16, 0)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = [tuple(r) for r in ed.near_duplicates(vectors, shard=shard, queries=100).collect()]
    assert brute.ordered(got) == brute.ordered(all_pairs(rows))
    assert ed.near_duplicates(vectors.limit(0)).count() == 0


def test_graph_finds_dense_groups():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1200, 32)), rng.normal(size=(1, 32)) + 0.03 * rng.normal(size=(500, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ed.Graph.build(x[rng.permutation(len(x))])
    found = ed.search(graph, x, 0.98)
    truth = [np.flatnonzero(graph.vectors @ q >= 0.98) for q in x]
    assert sum(map(len, found)) >= 0.99 * sum(map(len, truth))
    assert all(set(f) <= set(t) for f, t in zip(found, truth, strict=True))


def test_links_that_the_graph_lost():
    """Rare pairs whose partners no path of the graph reaches, among queries of which most have no link."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = rng.normal(size=(800, 32))
    # None is a multiple of 33, where an audit of 24 of 800 evenly spaced queries would fall.
    paired = np.arange(5, 800, 33)
    queries[paired] = x[100 + paired] + 0.01 * rng.normal(size=(len(paired), 32))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    graph = ed.Graph.build(x)
    for links in graph.links:
        links[np.isin(links, 100 + paired)] = -1
    found = ed.search(graph, queries, 0.98)
    truth = [np.flatnonzero(graph.vectors @ q >= 0.98) for q in queries]
    assert sum(map(len, truth)) == len(paired)
    assert all(set(f) == set(t) for f, t in zip(found, truth, strict=True))


def test_beams_are_used_and_audited(spark, monkeypatch):
    """Where links are rare no block is compared in full, and the recall of every shard's beam is known."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x[1400:] = x[:100] + 0.01 * rng.normal(size=(100, 24))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    shards = ed.audits(vectors, shard=512).collect()
    assert len(shards) == 4 and sum(r.vectors for r in shards) == 1500
    assert all(r.recall >= 0.9 and r.width < r.vectors for r in shards)
    got = [tuple(r) for r in ed.near_duplicates(vectors, shard=512, queries=200).collect()]
    wanted = all_pairs(rows)
    assert sum(n for _, n, _, _ in got) >= 0.9 * sum(n for _, n, _, _ in wanted) > 0
    assert all(n <= m for (_, n, _, _), (_, m, _, _) in zip(brute.ordered(got), brute.ordered(wanted), strict=True))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ed.Graph.build(x)
    graph.audit(0.98)
    compared = []
    monkeypatch.setattr(ed, "_compared", lambda *a: compared.append(a) or [])
    ed.search(graph, x[:300], 0.98)
    assert not compared and graph.recall == 1.0


def test_probes_lie_at_the_edge_of_a_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (ed.turned(x, 0.98, rng) * x).sum(axis=1)
    assert (near >= 0.98).all() and (near < 0.989).all()
