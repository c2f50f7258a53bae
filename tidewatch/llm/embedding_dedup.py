"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label and length are dealt to shards of ``SHARD`` vectors, or larger ones in a large label; each shard is a graph, built once and staged. A graph is audited when it is
built: ``PROBES`` of its vectors, and as many vectors turned away from one of them by just less than the angle of a link, are looked for by the
beam and by brute force. So the audit always has links to find, however rare they are among the vectors. The beam is widened until it finds
all links of the probes; that width, and the share of links found with it, are kept with the graph (``audits``). Vectors that no way over the links leads to
are known and compared directly. Every vector then asks every shard of its label with that
shard's beam, in blocks of queries. A beam that ends among vectors that link is widened until it ends outside; a vector that links with more
than ``WIDE`` others of a shard is compared with all of it instead, which is less work. Links are verified by their cosine in double precision. A block returns
numbers of links and a spanning forest, never its pairs; the forests are united to components.

Equal vectors are one node with a weight from the start. Defined results: a vector that is null, empty, zero or has a null or non-finite component, and
one without label or id, links with nothing and is its own component. Rows that repeat an id count as vectors of their own. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.tables import pick, staged

COSINE = 0.98
#: A label has one shard for so many vectors, then up to ``SHARDS`` larger ones, and more only above ``LARGEST`` vectors each: a query asks all of them.
SHARD = 1 << 12
SHARDS = 16
LARGEST = 1 << 16
QUERIES = 4096
NEIGHBOURS = 12
BUILD_BEAM = 48
BEAM = 24
#: Vectors of a shard, and turned ones, that its beam is audited by.
PROBES = 48
#: Above this width a query is compared with the whole shard.
WIDE = 512
#: Queries that are compared with all vectors at a time.
COMPARED = 256


class Graph:
    """Unit vectors with links on levels; ``links[0]`` holds all of them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n = len(vectors)
        self.links: list[np.ndarray] = [np.full((n, 2 * NEIGHBOURS), -1, np.int32)]
        self.entry, self.top = 0, 0
        #: Beam that found all links of the probes, and the share it found; all vectors are compared where no beam does.
        self.width, self.recall = BEAM, 1.0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        graph = cls(vectors)
        n = len(vectors)
        level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(NEIGHBOURS)).astype(int)
        for _ in range(int(level.max(initial=0))):
            graph.links.append(np.full((n, NEIGHBOURS), -1, np.int32))
        graph.top = int(level[0]) if n else 0
        for i in range(1, n):
            graph._insert(i, int(level[i]))
        return graph

    def _insert(self, i: int, level: int) -> None:
        q, start = self.vectors[i], [self.entry]
        for layer in range(self.top, -1, -1):
            found = self.beam(q, start, layer, BUILD_BEAM if layer <= level else 1)
            start = [j for _, j in found]
            if layer <= level:
                width = self.links[layer].shape[1]
                for j in self._spread(found, NEIGHBOURS):
                    self._connect(layer, i, j, width)
                    self._connect(layer, j, i, width)
        if level > self.top:
            self.top, self.entry = level, i

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one closer to a chosen neighbour than to the vector is passed over at first."""
        chosen: list[int] = []
        later = []
        for s, j in found:
            if len(chosen) == most:
                break
            if chosen and (self.vectors[chosen] @ self.vectors[j]).max() > s:
                later.append(j)
            else:
                chosen.append(j)
        return chosen + later[: most - len(chosen)]

    def _connect(self, layer: int, a: int, b: int, width: int) -> None:
        row = self.links[layer][a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        every = np.r_[row, b]
        near = self.vectors[every] @ self.vectors[a]
        order = np.argsort(-near, kind="stable")
        kept = self._spread([(float(near[k]), int(every[k])) for k in order], width)
        row[: len(kept)] = kept
        row[len(kept) :] = -1

    def beam(self, q: np.ndarray, start: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest vectors found from ``start`` on, nearest first."""
        links, vectors = self.links[layer], self.vectors
        seen = np.zeros(len(vectors), bool)
        seen[start] = True
        near = vectors[start] @ q
        open_ = [(-float(s), j) for s, j in zip(near, start, strict=True)]
        heapq.heapify(open_)
        best = [(-s, j) for s, j in open_]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while open_:
            s, j = heapq.heappop(open_)
            if len(best) == width and -s < best[0][0]:
                break
            others = links[j]
            others = others[others >= 0]
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            near = vectors[others] @ q
            for s, k in zip(near.tolist(), others.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, k))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, k))
                else:
                    continue
                heapq.heappush(open_, (-s, k))
        return sorted(best, reverse=True)

    def linked(self, q: np.ndarray, width: int, cosine: float) -> np.ndarray | None:
        """Vectors within ``cosine``; the beam is widened until it ends outside. None where it gets wider than ``WIDE``."""
        start = [self.entry]
        for layer in range(self.top, 0, -1):
            start = [j for _, j in self.beam(q, start, layer, 1)]
        while True:
            found = self.beam(q, start, 0, min(width, len(self.vectors)))
            if found[-1][0] < cosine or len(found) == len(self.vectors) or len(found) < width:
                return np.array([j for s, j in found if s >= cosine], np.int64)
            if width >= WIDE:
                return None
            width *= 2

    def lost(self) -> np.ndarray:
        """Vectors that no way over the links leads to from the entry; queries are compared with these directly."""
        seen = np.zeros(len(self.vectors), bool)
        front = np.array([self.entry])
        while len(front):
            seen[front] = True
            others = np.unique(self.links[0][front])
            others = others[others >= 0]
            front = others[~seen[others]]
        return np.flatnonzero(~seen)

    def audit(self, cosine: float, seed: int = 2) -> None:
        """Sets ``width`` and ``recall`` by probes whose links are found by brute force."""
        rng = np.random.default_rng(seed)
        chosen = self.vectors[rng.choice(len(self.vectors), min(PROBES, len(self.vectors)), replace=False)]
        probes = np.concatenate([chosen, turned(chosen, cosine, rng)])
        wanted = _compared(self, probes, cosine)
        links = sum(map(len, wanted))
        while self.width < min(len(self.vectors), WIDE):
            got = [self.linked(q, self.width, cosine) for q in probes]
            # A probe whose beam gets too wide is one that will be compared.
            found = sum(len(w) if g is None else len(np.intersect1d(g, w)) for g, w in zip(got, wanted, strict=True))
            self.recall = found / links if links else 1.0
            if found == links:
                return
            self.width *= 2
        self.width, self.recall = len(self.vectors), 1.0


def turned(vectors: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors at a cosine between ``cosine`` and 1 to ``vectors``, nearer to the former."""
    if vectors.shape[1] < 2:
        return vectors.copy()
    aside = rng.normal(size=vectors.shape)
    aside -= (aside * vectors).sum(axis=1, keepdims=True) * vectors
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    near = 1 - (1 - cosine) * rng.uniform(0.6, 0.98, (len(vectors), 1))
    return near * vectors + np.sqrt(1 - near**2) * aside


def search(graph: Graph, queries: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Links of every query, by the audited beam; those with very many links by comparison."""
    if graph.width >= len(graph.vectors):
        wide, found = list(range(len(queries))), [None] * len(queries)
    else:
        found = [graph.linked(q, graph.width, cosine) for q in queries]
        wide = [i for i, links in enumerate(found) if links is None]
        lost = graph.lost()
        beside = np.argwhere(queries @ graph.vectors[lost].T >= cosine) if len(lost) else []
        for i, j in beside:
            if found[i] is not None:
                found[i] = np.append(found[i], lost[j])
    for a in range(0, len(wide), COMPARED):
        part = wide[a : a + COMPARED]
        for i, links in zip(part, _compared(graph, queries[part], cosine), strict=True):
            found[i] = links
    return found


def _compared(graph: Graph, queries: np.ndarray, cosine: float) -> list[np.ndarray]:
    return [np.flatnonzero(near) for near in queries @ graph.vectors.T >= cosine]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


def _builder(cosine: float):
    def build(key, table):
        vectors = _matrix(table.column("unit"))
        graph = Graph.build(vectors)
        graph.audit(cosine)
        return _stored(key, table, vectors, graph)

    return build


def _stored(key, table: pa.Table, vectors: np.ndarray, graph: Graph) -> pa.Table:
    return pa.table(
        {
            "label": pa.array([key[0].as_py()], key[0].type), "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int64()),
            "nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
            "weights": pa.array([table.column("weight").to_pylist()], pa.list_(pa.int64())),
            "vectors": [vectors.tobytes()], "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
            "entry": pa.array([[graph.entry, graph.top, graph.width]], pa.list_(pa.int64())), "recall": pa.array([graph.recall]),
        }
    )


def _ask(cosine: float):
    def ask(key, graphs, queries):
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        if not graphs.num_rows or not queries.num_rows:
            return empty
        row = graphs.slice(0, 1).to_pylist()[0]
        nodes, weights = np.array(row["nodes"]), np.array(row["weights"])
        graph = Graph(np.frombuffer(row["vectors"]).reshape(len(nodes), -1))
        graph.links = [np.frombuffer(x, np.int32).reshape(len(nodes), -1) for x in row["links"]]
        graph.entry, graph.top, graph.width = row["entry"]
        asking, own = queries.column("node").to_numpy(), queries.column("weight").to_numpy()
        at = set(nodes.tolist())
        found = search(graph, _matrix(queries.column("unit")), cosine)
        number = {int(x): i for i, x in enumerate(dict.fromkeys([*asking.tolist(), *nodes.tolist()]))}
        parent = list(range(len(number)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        n_links = []
        for q, w, links in zip(asking.tolist(), own.tolist(), found, strict=True):
            linked = nodes[links]
            # A node's own copies are counted from its weight, in its own shard.
            n_links.append(int(weights[links[linked != q]].sum()) + (w - 1 if q in at else 0))
            for x in linked.tolist():
                parent[root(number[x])] = root(number[q])
        names = list(number)
        a = [*asking.tolist(), *names]
        b = [*asking.tolist(), *[names[root(i)] for i in range(len(names))]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array([*n_links, *[0] * len(names)], pa.int64())})

    return ask


def _graphs(vectors: DataFrame, id_column, vector_column, label_column, cosine, shard, queries):
    """Keyed rows, different vectors, sizes of labels, vectors to deal out, and the staged graphs."""
    rows = pick(vectors, vec_id=id_column, v=vector_column, label=label_column)
    rows = rows.withColumn("v", F.col("v").cast("array<double>")).withColumn("dim", F.size("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    keyed = rows.withColumn("usable", usable)
    keyed = keyed.withColumn("k1", F.xxhash64("label", "dim", "v")).withColumn("k2", F.xxhash64(F.lit(7), "label", "dim", "v"))
    good = keyed.where("usable")
    # Scaled first, so that squares neither overflow nor vanish.
    scale = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("scale"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x))
    nodes = good.groupBy("k1", "k2").agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("weight"))
    one = good.groupBy("k1", "k2", "label", "dim", "v").agg(F.lit(1).alias("one")).drop("one")
    nodes = one.join(nodes, ["k1", "k2"]).withColumn("scale", scale).withColumn("scaled", scaled).withColumn("norm", norm)
    # Two different vectors may bear one id; a node is numbered, and named by its least id at the end.
    nodes = nodes.select("k1", "k2", "label", "dim", F.col("node").alias("least_id"), "weight", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") / F.greatest(F.lit(shard), F.least(F.lit(LARGEST), F.col("n") / SHARDS))).alias("shards"), F.ceil(F.col("n") / queries).alias("blocks"))
    dealt = nodes.select("label", "dim", "node", "weight", "unit").join(sizes, ["label", "dim"])
    label_type = rows.schema["label"].dataType.simpleString()
    shards = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    graphs = shards.select("label", "dim", "shard", "node", "weight", "unit").groupBy("label", "dim", "shard").applyInArrow(
        _builder(cosine),
        f"label {label_type}, dim int, shard long, nodes array<bigint>, weights array<bigint>, vectors binary, links array<binary>, entry array<bigint>, recall double",
    )
    graphs = staged(graphs, "graphs")
    return keyed, nodes, sizes, dealt, graphs


def audits(vectors: DataFrame, id_column="vec_id", vector_column="embedding", label_column="label", cosine=COSINE, shard=SHARD) -> DataFrame:
    """Per shard: label, dim, shard, vectors, width of its beam, recall of the probes' links with it."""
    *_, graphs = _graphs(vectors, id_column, vector_column, label_column, cosine, shard, QUERIES)
    return graphs.select("label", "dim", "shard", F.size("nodes").alias("vectors"), F.col("entry")[2].alias("width"), "recall")


def near_duplicates(
    vectors: DataFrame, id_column="vec_id", vector_column="embedding", label_column="label", cosine=COSINE, shard=SHARD, queries=QUERIES
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    keyed, nodes, sizes, dealt, graphs = _graphs(vectors, id_column, vector_column, label_column, cosine, shard, queries)
    graphs = graphs.drop("recall").join(sizes, ["label", "dim"])
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("shards", "blocks")
    asked = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))).drop("shards", "blocks")
    keys = ["label", "dim", "shard", "block"]
    answers = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_ask(cosine), "a long, b long, n_links long")
    answers = staged(answers, "answers")
    counts = answers.groupBy("a").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("a", "node")
    component = connected_components(answers, "a", "b")
    named = nodes.select("k1", "k2", "node", "least_id").join(counts, "node", "left").join(component, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "n_links", "component_id", F.lit(True).alias("usable"))
    out = keyed.select("vec_id", "k1", "k2", "usable").join(named, ["k1", "k2", "usable"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
