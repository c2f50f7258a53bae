"""N-gram Jaccard join: which documents link (similarity of 0.8 or more), as connected components.

1. One pass over the texts hashes the distinct 5-word shingles of each document (64 bits) and staged a row per
   document: size, a 128-bit digest of the set, and the part of the set that lies in the *region* of its size.
   A region is a range of hashes, wider than the fifth of a set that may be missing in a partner.
2. Shingles of the regions are counted with map-side aggregates. Global order: rare shingles first. Of a set of size n
   at most n/5 elements are missing in any partner, so two sets that link share an element among the
   first n/5 + 1 of the region of each (its prefix). A document with more shingles of its own than that
   links with nothing and is done; in a corpus of mostly unrelated texts these are nearly all.
3. Equal sets are one node from here on. Nodes meet in lists, one for each prefix shingle; lists with nodes in common are
   a family. The sets of a family are sent once, in blocks of ``BLOCK``, one group per pair of blocks. A block
   is held as a prefix tree, see ``prefix_tree``.
4. In a large family own shingles and lists are counted anew over the full sets. The nodes of each list are compared with the most
   central one first (fewest shingles of its own), in parts of a block. Components follow; a list whose nodes are all in
   one component is done. What is left goes by family or list by list, in pairs of blocks. Nodes
   with too many shingles of their own are left out of comparisons that their sizes rule out.

Sets whose region is too small for step 2 (bad luck of hashing) are probed against the full sets of all documents.

Defined results: a null or blank text has an empty set and links with nothing; a null id links with nothing and has a
null component. Rows that repeat an id are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.prefix_tree import PrefixTree
from tidewatch.llm.tables import pick, release, staged
from tidewatch.llm.textops import LOWER, chunks, flat, mix, word_bounds, word_hashes
from tidewatch.session import cut

WORDS = 5
BLOCK = 128
#: Families of nodes that meet anywhere are compared as one if they fill at most this many blocks; others list by list.
SMALL_BLOCKS = 4
#: Blocks of what is left of a large family are larger by this factor; most of its nodes are known to be linked.
LARGE_BLOCKS = 8
#: Rows of a few numbers that are broadcast at the most (under 100 MB); more are joined by shuffle, with the same result.
BROADCAST_ROWS = 2_000_000
#: (smallest size, share of the hash range). Sizes overlap by a quarter, so sets that may link have a level in common.
LEVELS = ((1, 1.0), (200, 0.375), (800, 0.29), (3200, 0.245))


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, starts = flat(text)
    data = LOWER[data]
    first, end, bounds = word_bounds(data, starts)
    words = word_hashes(data, first, end)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = mix(rolled ^ words[k : k + len(rolled)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            hashes = np.sort(rolled[a : b - WORDS + 1])
            out.append(hashes[np.r_[True, hashes[1:] != hashes[:-1]]])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mix(h ^ words[k : k + 1])
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = mix(hashes).sum(dtype=np.uint64), mix(~hashes).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def missing(n: int) -> int:
    """Elements of a set of size n that a partner may lack."""
    return n // 5


def levels_of(n: int, levels) -> list[int]:
    ends = [low for low, _ in levels[1:]] + [None]
    return [i for i, ((low, _), end) in enumerate(zip(levels, ends, strict=True)) if n >= low and (end is None or 4 * n < 5 * end)]


def _regions(hashes: np.ndarray, levels) -> tuple[list[int], list[np.ndarray]]:
    which = levels_of(len(hashes), levels)
    parts = [hashes if levels[i][1] >= 1 else hashes[: np.searchsorted(hashes, np.uint64(int(levels[i][1] * 2**64)))] for i in which]
    return which, parts


def _described(levels):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            digests = [digest(s) for s in sets]
            regions, thin = [], []
            for s in sets:
                which, parts = _regions(s, levels)
                thin.append(any(len(p) <= missing(len(s)) for p in parts))
                # The level goes into the hash, so that levels do not meet. 48 bits order and count shingles; two that
                # fall together add a candidate, but lose none.
                regions.append([(len(p), (mix(p + np.uint64(i)) >> np.uint64(16)).view(np.int64)) for i, p in zip(which, parts, strict=True)])
            flat_regions = [(i, n, r) for i, rs in enumerate(regions) for n, r in rs]
            ends = np.cumsum([0] + [n for _, n, _ in flat_regions])
            values = pa.array(np.concatenate([r for _, _, r in flat_regions]) if flat_regions else np.zeros(0, np.int64), pa.int64())
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in regions]), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(thin, pa.bool_()),
                    outer,
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "thin", "regions"],
            )

    return describe


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the documents asked for, by the digest that the first pass gave them; other columns are passed on."""
    for batch in chunks(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        wanted = list(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True))
        keep = [i for i, s in enumerate(sets) if len(s) and digest(s) == wanted[i]]
        names = [c for c in batch.schema.names if c not in ("text", "d1", "d2")]
        rest = [batch.column(c).take(pa.array(keep, pa.int32())) for c in names]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=[*names, "hashes"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows (g1, g2); the rows come sorted by group.

    ``role`` 0 probes, 1 is a member, 2 is both. Nodes of one component are not compared, and nodes that a link
    found here connects count as one component.
    """
    held: list[tuple] = []
    group = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("g1", "g2", "node", "component", "role", "own", "hashes")]
        out: list[tuple[int, int]] = []
        for g1, g2, *row in zip(*columns, strict=True):
            if (g1, g2) != group:
                out += _links_within(held)
                held, group = [], (g1, g2)
            held.append(row)
        yield _link_batch(out)
    yield _link_batch(_links_within(held))


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _apart(n: int, own_n: int, m: np.ndarray, own_m: np.ndarray) -> np.ndarray:
    """Where sets of sizes n and m cannot link, of which so many elements are in no other set.

    A link needs 4/9 of n + m in common, so the first set lacks a partner for (5n - 4m) / 9 elements at most.
    """
    return (9 * own_n > 5 * n - 4 * m) | (9 * own_m > 5 * m - 4 * n)


def _links_within(rows: list) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    members = [r for r in rows if r[2] >= 1]
    tree = PrefixTree([np.frombuffer(r[4], np.uint64) for r in members])
    # Component of each node, by number; those of a group become one where a link is found.
    number = {c: i for i, c in enumerate(dict.fromkeys(r[1] for r in rows))}
    alias = np.arange(len(number))
    component = np.array([number[members[i][1]] for i in tree.order])
    own = np.array([members[i][3] for i in tree.order], np.int64)
    out = []
    for node, its_component, role, its_own, hashes in rows:
        if role == 1:
            continue
        probe = np.frombuffer(hashes, np.uint64)
        me = number[its_component]
        wanted = (alias[component] != alias[me]) & ~_apart(len(probe), its_own, tree.sizes, own)
        for place in tree.links(probe, wanted, skip=lambda k, me=me: alias[component[k]] == alias[me]):
            out.append((node, members[tree.order[place]][0]))
            alias[alias == alias[component[place]]] = alias[me]
    return out


def _verify(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``groups`` (g1, g2, node, component, role) with the sets joined in; the links found."""
    return _linked(groups.join(sets, "node"))


def _linked(rows: DataFrame) -> DataFrame:
    rows = rows.select("g1", F.explode("g2s").alias("g2"), "node", "component", "role", "own", "hashes")
    rows = rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "role", "node")
    return rows.mapInArrow(_joined, "a long, b long")


def _thin_links(docs: DataFrame, described: DataFrame) -> DataFrame | None:
    """Links of sets with too small a region, as pairs of digests' nodes: counts over the full sets of all documents."""
    thin = described.where("thin AND doc_id IS NOT NULL").select("d1", "d2").distinct()
    if not thin.limit(1).count():
        return None
    nodes = described.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    nodes = nodes.withColumn("node", F.xxhash64("d1", "d2"))
    items = _made(docs, nodes.select("doc_id", "d1", "d2", "node")).mapInArrow(_exploded, "item long, h long").distinct().withColumnRenamed("item", "node")
    probes = thin.select(F.xxhash64("d1", "d2").alias("node")).join(items, "node").select(F.col("node").alias("a"), "h")
    counts = probes.join(items.withColumnRenamed("node", "b"), "h").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    sizes = nodes.select("node", "n")
    counts = counts.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return counts.where("100 * c >= 80 * (na + nb - c)").select("a", "b")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, hashes in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            values = np.frombuffer(hashes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node, np.int64)), pa.array(values)], names=["item", "h"])


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows, of a few numbers each, are counted to be few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _families(edges: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, family) of all nodes that meet, and the part of it in families of ``SMALL_BLOCKS`` blocks at most, with sizes."""
    family = cut(connected_components(edges, "a", "b").withColumnRenamed("component", "family"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("k"))
    return family, family.join(sizes.where(F.col("k") <= SMALL_BLOCKS * block), "family")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Groups for pairs of blocks of (g1, k, node, component): nodes are dealt by hash, so blocks are of about equal size."""
    rows = rows.withColumn("blocks", F.ceil(F.col("k") / block)).withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.least("own_block", o) * F.col("blocks") + F.greatest("own_block", o))
    return rows.select("g1", pairs.alias("g2s"), "node", "component", F.lit(2).alias("role"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, d1, d2, copies, ...) with the sets of their documents, made from the texts anew; one row per node.

    Without doc_id, d1, d2 and copies. A row that is stored several times makes as many sets, which become one here.
    """
    made = _made(docs, nodes.where("copies = 1"))
    again = nodes.where("copies > 1")
    return made.unionByName(_made(docs, again).dropDuplicates(["node"])) if again.limit(1).count() else made


def _made(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_small(nodes.drop("copies")), "doc_id").drop("doc_id")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "d1", "d2"))
    return rows.mapInArrow(_full_sets, f"{kept}, hashes binary")


def _prefix_lists(items: DataFrame, shared: DataFrame, chosen: DataFrame) -> DataFrame:
    """(h, node, own, n_shingles, center): the lists of two nodes or more.

    ``items`` (item, h), ``shared`` (h, df), ``chosen`` (item, node, n_shingles, own). The prefix of an item starts with its own
    shingles, which are in no list, and goes on with the rarest shared ones.
    """
    met = items.join(shared, "h").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("p"))
    prefixes = met.join(chosen, "item").select(
        "node", "own", "n_shingles", F.explode(F.expr("slice(p, 1, cast(n_shingles div 5 + 1 - own as int))")).alias("e")
    )
    lists = prefixes.select("node", "own", "n_shingles", F.col("e.h").alias("h"))
    center = lists.groupBy("h").agg(F.min(F.struct("own", "node")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return lists.join(center.select("h", F.col("m.node").alias("center")), "h")


def _counted(items: DataFrame) -> DataFrame:
    """One table for two uses: (item, null, number of shingles of its own) and (null, shingle, its count)."""
    counted = items.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("item").alias("item"))
    single = F.col("df") == 1
    counted = counted.select(F.when(single, F.col("item")).alias("item"), F.when(~single, F.col("h")).alias("h"), "df")
    return staged(counted.groupBy("item", "h").agg(F.count(F.lit(1)).alias("own"), F.max("df").alias("df")), "shingle-counts")


def _links_of_large(sets: DataFrame, block: int) -> DataFrame:
    """Links in large families, from their full sets: own shingles and prefixes are counted anew, without regions.

    A node with ``own`` shingles that no other has can only link with one that is not too large: see ``_apart``.
    """
    items = sets.select("node", "hashes").mapInArrow(_exploded, "item long, h long")
    counted = _counted(items)
    own = counted.where("item IS NOT NULL").select("item", "own")
    sizes = sets.select(F.col("node").alias("item"), "node", F.expr("cast(octet_length(hashes) div 8 as long)").alias("n_shingles"))
    chosen = cut(sizes.distinct().join(own, "item", "left").fillna(0, ["own"]).where("own <= n_shingles div 5"))
    shared = counted.where("h IS NOT NULL").select("h", "df")
    sets = sets.join(chosen.select("node", "own"), "node")
    items = sets.select("node", "hashes").mapInArrow(_exploded, "item long, h long")
    lists = staged(_prefix_lists(items, shared, chosen), "full-lists")

    stars = lists.where("node <> center").select("center", "node").distinct()
    partners = stars.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    stars = stars.join(partners, "center").withColumn("g2", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = stars.select(F.col("center").alias("g1"), F.array("g2").alias("g2s"), "node", F.col("node").alias("component"), F.lit(1).alias("role"))
    probes = partners.select(F.col("center").alias("g1"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("g2s"))
    probes = probes.select("g1", "g2s", F.col("g1").alias("node"), F.col("g1").alias("component"), F.lit(0).alias("role"))
    links = cut(_verify(rows.unionByName(probes), sets))
    release(sets.sparkSession)

    found = connected_components(links, "a", "b")
    labelled = cut(lists.join(found, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component")))
    left = labelled.groupBy("h").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("a"), F.count(F.lit(1)).alias("k"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x2"),
    ).where("lo <> hi")
    # Lists of the same nodes are one.
    once = left.groupBy("k", "x1", "x2").agg(F.min(F.struct("h", "a")).alias("m")).select("m.h", "m.a", "k")
    rest = cut(labelled.join(once, "h"))
    release(sets.sparkSession)
    # Either all nodes of a family meet in large blocks, or list by list in small ones; whichever sends fewer sets.
    family = connected_components(rest.select("a", F.col("node").alias("b")), "a", "b").withColumnRenamed("component", "family")
    placed = cut(rest.join(family, "node"))
    members = placed.select("family", "node", "component").distinct()
    whole = members.groupBy("family").agg(F.count(F.lit(1)).alias("f"))
    by_list = placed.groupBy("family").agg(F.sum(F.ceil(F.col("k") / block)).alias("sent"))
    better = F.col("f") * F.ceil(F.col("f") / (LARGE_BLOCKS * block)) <= F.col("sent")
    plan = cut(whole.join(by_list, "family").select("family", "f", better.alias("whole")))
    near = members.join(plan.where("whole"), "family").select(F.col("family").alias("g1"), F.col("f").alias("k"), "node", "component")
    far = placed.join(plan.where("NOT whole"), "family").select(F.col("h").alias("g1"), "k", "node", "component")
    found = _verify(_blocks(near, LARGE_BLOCKS * block), sets).unionByName(_verify(_blocks(far, block), sets))
    return links.unionByName(found)


def similarity_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", levels=LEVELS, block: int = BLOCK
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = pick(docs, doc_id=id_column, text=text_column)
    schema = "doc_id long, n_shingles long, d1 long, d2 long, thin boolean, regions array<array<bigint>>"
    described = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_described(levels), schema)
    described = staged(described.withColumn("row", F.monotonically_increasing_id()), "shingles")

    usable = described.where("doc_id IS NOT NULL AND n_shingles > 0 AND NOT thin")
    levelled = usable.select("row", "n_shingles", F.posexplode("regions").alias("level", "region"))
    levelled = levelled.withColumn("item", F.col("row") * 2 + F.col("level"))
    counted = _counted(levelled.select("item", F.explode("region").alias("h")))
    own = counted.where("item IS NOT NULL").select("item", "own")
    # Documents that may link: at most a fifth of their shingles are their own.
    open_items = levelled.select("item", "row", "n_shingles").join(own, "item", "left")
    open_items = staged(open_items.fillna(0, ["own"]).where("own <= n_shingles div 5"), "open")
    narrow = described.select("row", "doc_id", "n_shingles", "d1", "d2")
    open_rows = narrow.join(_small(open_items.select("row").distinct()), "row", "left_semi")
    # Equal sets are one node, named after one of their rows; ``copies`` rows have its id and set.
    nodes = open_rows.groupBy("d1", "d2", "doc_id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row", "copies")).alias("m"))
    nodes = staged(nodes.select("d1", "d2", F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias("node"), F.col("m.copies").alias("copies")), "nodes")
    release(docs.sparkSession)

    chosen = open_items.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    shared = counted.where("h IS NOT NULL").select("h", "df")
    regions = levelled.select("item", "region").join(_small(chosen.select("item")), "item")
    lists = _prefix_lists(regions.select("item", F.explode("region").alias("h")), shared, chosen)
    lists = staged(lists.select("node", "center").distinct(), "lists")
    release(docs.sparkSession)

    family, small = _families(lists.select(F.col("center").alias("a"), F.col("node").alias("b")), block)
    groups = _blocks(small.select(F.col("family").alias("g1"), "k", "node", F.col("node").alias("component")), block)
    links = _linked(_sets(docs, cut(nodes.join(groups, "node"))).withColumn("own", F.lit(0).cast("long")))
    large = cut(family.join(small, "node", "left_anti").select("node"))
    release(docs.sparkSession)
    if large.limit(1).count():
        sets = staged(_sets(docs, nodes.join(large, "node", "left_semi")), "sets")
        links = links.unionByName(_links_of_large(sets, block))
    links = cut(links)
    release(docs.sparkSession)

    names = nodes.select(F.col("node").alias("a"), F.xxhash64("d1", "d2").alias("name"))
    thin = _thin_links(docs, described)
    if thin is not None:
        links = links.join(names, "a").select(F.col("name").alias("a"), "b")
        links = links.join(names.withColumnRenamed("a", "b"), "b").select("a", F.col("name").alias("b")).unionByName(thin)
        names = described.where("doc_id IS NOT NULL AND n_shingles > 0").select(F.xxhash64("d1", "d2").alias("a"), F.xxhash64("d1", "d2").alias("name")).distinct()
    found = connected_components(links, "a", "b").withColumnRenamed("node", "a")

    # Sets in no component of several keep their own smallest id.
    digests = described.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least_id"))
    if thin is None:
        digests = digests.join(nodes.select("d1", "d2", F.col("node").alias("a")), ["d1", "d2"], "left")
    else:
        digests = digests.withColumn("a", F.xxhash64("d1", "d2"))
    placed = digests.join(found, "a", "left")
    smallest = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(smallest, "component", "left").select("d1", "d2", F.coalesce("component_id", "least_id").alias("component_id"))
    out = narrow.join(placed, ["d1", "d2"], "left")
    own_id = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"))
