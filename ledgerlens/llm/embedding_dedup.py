"""Embedding near-duplicates by NN-descent within a label, audited against brute force.

1. Equal vectors of a label become one node with a multiplicity.
2. A first neighbour graph: for each of TREES random projections the nodes of
   a label are sorted by the signs of their projections (a distributed range
   sort), and each run of LEAF rows is compared within itself.
3. Rounds of NN-descent: every node meets the neighbours of its neighbours
   (forward and reverse, NEIGHBOURS of each) and keeps the nearest, until a
   round changes little, however many that takes. Only nodes with a neighbour
   that is new since the last round take part, and only pairs with a new one.
   A node whose list is full of links is saturated: more of its links may be
   missing. While there are such nodes, lists get GROWTH times longer (up to MOST),
   what is added has to link, and the descent goes on from the saturated nodes,
   over the edges at their components only.
4. Edges at the threshold are kept and give components. The nodes that are
   saturated even so make blocks of about BLOCK nodes of each component with a
   centre and a radius (an angle); all blocks of a label whose centres are not too far
   apart for a link are compared exactly, and components that link become one.
   A link whose two ends are saturated is so never lost to the lists' length,
   and one with an end that is not saturated is in that end's list.
5. Links are counted inside each component, all nodes with all, in blocks of
   at most about BLOCK nodes a side.
6. Audit: of the components of each size class (powers of two), AUDIT nodes,
   the first by hash, are compared with all rows in one pass. Recall is the
   mean over nodes, weighted by how many nodes of the class each stands for,
   taken apart for each class of true links; the least class counts. Below
   RECALL all nodes are compared, in the blocks of step 4, which is exact and
   quadratic in a label's distinct vectors; the recall is taken again, and if
   it is still below, that is an error. It is returned with the result.

Cosines of kept links are computed in double precision; none is below the
threshold. Components follow the links found.

Defined cases: a vector that is null, empty or zero, or has null or non-finite
components, or whose label is null, links with nothing; vectors of different
length never link; ids may repeat or be null (a null id names a component only
if all its ids are null); other columns are ignored; an empty table gives an
empty result. Distinct vectors are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, release, small, table
from ledgerlens.llm.graph import components

THRESHOLD = 0.98
NEIGHBOURS, TREES, LEAF, SIGNS = 6, 8, 128, 14
#: Lists of saturated nodes get so many times longer, and at most this long.
GROWTH, MOST = 4, 24
LITTLE = 0.01
BLOCK = 256
#: Numbers of the centres on each side that meet in one row, and the slack of the angle bound.
CENTRES, SLACK = 1 << 17, 1e-6
AUDIT, RECALL = 512, 0.99


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, label, dim, vec, copies, id: the distinct usable vectors of each label."""
    v = F.col("vec")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = vectors.filter(usable)
    return materialize(fine.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("id")).select(F.xxhash64("label", "vec").alias("node"), "label", F.size("vec").alias("dim"), "vec", "copies", "id"), "nodes")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges (a, b, sim, ...) of each a, each pair once.

    Every task keeps the k best of its own rows before they are shuffled and
    the ranks are read off a sort, so a node with very many edges is no group
    in memory.
    """
    rank = F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.desc("b")))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank").dropDuplicates(["a", "b"])


def _same(sims: np.ndarray) -> np.ndarray:
    """Cosines cut after 14 digits, so that a pair has one value wherever it is computed."""
    return np.floor(sims * 1e14) / 1e14


def signs(size: int) -> int:
    """How many signs a code has: at least SIGNS, and more codes than ``size`` nodes."""
    return min(max(SIGNS, size.bit_length()), 62)


def first_graph(nodes: DataFrame, seed: int, bits: int) -> DataFrame:
    """(a, b, sim) from runs of rows that are near each other in one of TREES sort orders by ``bits`` signs."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("vec"))
                for tree in range(TREES):
                    planes = np.random.default_rng([seed, tree, int(dim)]).standard_normal((int(dim), bits))
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int32()), pa.array(code.astype(np.int64)), *(part.column(c) for c in ("label", "dim", "node", "vec"))], ["tree", "code", "label", "dim", "node", "vec"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "label", "dim")])
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                for at in range(start, end, LEAF):
                    to = end if end - at < 1.5 * LEAF else at + LEAF
                    leaf = batch.slice(at, to - at)
                    yield near(leaf.column("node").to_numpy(), _matrix(leaf.column("vec")))
                    if to == end:
                        break

    def near(node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = _same(x @ x.T)
        np.fill_diagonal(sims, -2)
        k = min(NEIGHBOURS, len(node) - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(node, max(k, 0))), pa.array(node[best.ravel()]), pa.array(np.take_along_axis(sims, best, axis=1).ravel())], ["a", "b", "sim"])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    rows = nodes.select("node", "label", "dim", "vec").mapInArrow(keyed, f"tree int, code long, label {kinds['label']}, dim int, node long, vec {kinds['vec']}")
    order = ["tree", "label", "dim", "code", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "label", "dim", "node", "vec").mapInArrow(leaves, "a long, b long, sim double")


def descend(graph: DataFrame, nodes: DataFrame, k: int, floor: float) -> DataFrame:
    """New (a, b, sim) above ``floor`` that beat a's list of ``k``: pairs among the neighbours, forward and reverse, of each node, one of them new. graph: a, b, sim, new."""
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.greatest(F.min("sim"), F.lit(floor))).otherwise(F.lit(floor)).alias("worst")).select(F.col("a").alias("w"), "worst")
    reverse = _nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new"), k)
    near = graph.unionByName(reverse).groupBy(F.col("a").alias("centre"), F.col("b").alias("member")).agg(F.bool_or("new").alias("new"))
    near = near.join(near.filter("new").select("centre").distinct(), "centre", "left_semi")
    seen = near.join(nodes.select("node", "vec"), F.col("member") == F.col("node")).join(worst, F.col("member") == F.col("w"), "left")
    met = seen.groupBy("centre").agg(F.collect_list("member").alias("m"), F.collect_list(F.coalesce("worst", F.lit(floor))).alias("w"), F.collect_list("new").alias("f"), F.flatten(F.collect_list("vec")).alias("v"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for m, w, f, v in zip(batch.column("m"), batch.column("w"), batch.column("f"), batch.column("v"), strict=True):
                node, worst, new = m.values.to_numpy(), w.values.to_numpy(), f.values.to_numpy(zero_copy_only=False)
                x = v.values.to_numpy().astype(np.float64).reshape(len(node), -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sims = _same(x @ x.T)
                np.fill_diagonal(sims, -3)
                a, b = np.nonzero((sims > worst[:, None]) & (new[:, None] | new[None, :]))
                for held, more in zip(out, (node[a], node[b], sims[a, b]), strict=True):
                    held.append(more)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if x else pa.array([], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "sim"])

    return met.select("m", "w", "f", "v").mapInArrow(pairs, "a long, b long, sim double")


def refine(graph: DataFrame, nodes: DataFrame, k: int, floor: float, enough: float) -> DataFrame:
    """``graph`` after rounds of descent, until a round brings at most ``enough`` new edges; lists only get nearer, so this ends."""
    while True:
        better = _nearest(graph.drop("new").unionByName(descend(graph, nodes, k, floor)), k)
        old = graph.select("a", "b", F.lit(True).alias("old"))
        before, graph = graph, materialize(better.join(old, ["a", "b"], "left").select("a", "b", "sim", F.col("old").isNull().alias("new")), "graph")
        release(before)
        if graph.filter("new").count() <= enough:
            return graph


def saturated(graph: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node): the nodes whose whole list of ``k`` links."""
    return graph.filter(F.col("sim") >= threshold).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("node")


def neighbour_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """(a, b, sim, new): the NN-descent graph of NEIGHBOURS neighbours each."""
    size = nodes.count()
    graph = materialize(_nearest(first_graph(nodes, seed, signs(size)), NEIGHBOURS).withColumn("new", F.lit(True)), "graph")
    return refine(graph, nodes, NEIGHBOURS, -2.0, LITTLE * NEIGHBOURS * size)


def around(graph: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame:
    """The edges of ``graph`` with an end in a component that has a node of ``full``; links or not, as they may lead to links between components."""
    hot = roots.join(full, "node", "left_semi").select("component").distinct()
    held = roots.join(small(hot), "component", "left_semi").select("node")
    ends = {c: held.select(F.col("node").alias(c)) for c in ("a", "b")}
    return graph.join(ends["a"], "a", "left_semi").unionByName(graph.join(ends["a"], "a", "left_anti").join(ends["b"], "b", "left_semi"))


def enlarge(graph: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The edges ``around`` saturated nodes with longer lists, by descent from these nodes, while there are any and up to MOST; and (node), those that are saturated even so. roots: the components of ``graph``'s links."""
    k, part = NEIGHBOURS, None
    full = materialize(saturated(graph, threshold, k), "saturated")
    while (stalled := full.count()) and k < MOST:
        k = min(GROWTH * k, MOST)
        marked = full.select(F.col("node").alias("a"), F.lit(True).alias("new"))
        edges = around(graph, roots, full) if part is None else part
        before, part = part, materialize(edges.drop("new").join(marked, "a", "left").withColumn("new", F.coalesce("new", F.lit(False))), "part")
        if before is None:  # neighbours of neighbours are ends of the same edges, so no round needs other vectors
            ends = part.select(F.col("a").alias("node")).unionByName(part.select(F.col("b").alias("node"))).distinct()
            nodes = materialize(nodes.select("node", "vec").join(ends, "node", "left_semi"), "ends")
        else:
            release(before)
        release(full)
        # what is added has to link; cosines are cut after 14 digits, so one at the very threshold may lie under it
        part = refine(part, nodes, k, threshold - 1e-12, LITTLE * k * stalled)
        full = materialize(saturated(part, threshold, k), "saturated")
    return graph if part is None else part, full


def across(edges: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of components that a link of ``edges`` joins; a node without a root is its own component."""
    root = {c: roots.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")}
    met = edges.filter(F.col("sim") >= threshold).select("a", "b").join(root["a"], "a", "left").join(root["b"], "b", "left")
    return met.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct()


def bridges(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of components that a link between two of ``nodes`` joins; a node without a root is its own component. Exact."""
    rows = nodes.select("node", "label", "dim", "vec").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("parts"))
    placed = rows.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
    grouped = placed.groupBy("label", "dim", "component", "part").agg(F.flatten(F.collect_list("vec")).alias("v")).select(F.xxhash64("component", "part", "label", "dim").alias("block"), "label", "dim", "component", "v")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}

    def unit(v: pa.Scalar, dim: int) -> np.ndarray:
        x = v.values.to_numpy().astype(np.float64).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for v, dim in zip(batch.column("v"), batch.column("dim").to_pylist(), strict=True):
                x = unit(v, dim)
                c = x.sum(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
                centres.append(c)
                radii.append(float(np.arccos(np.clip((x @ c).min(), -1, 1))) if len(x) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], [*batch.schema.names, "centre", "radius"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("block", "label", "dim", "component", "v")) + ", centre array<double>, radius double"
    blocks = materialize(grouped.mapInArrow(centred, schema), "centres")
    share = F.greatest(F.lit(1), F.floor(F.lit(CENTRES) / F.col("dim")))
    sizes = blocks.groupBy("label", "dim").agg(F.count("*").alias("n")).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("n") / share).cast("long").alias("parts"))
    dealt = blocks.join(F.broadcast(sizes), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).withColumn("part", F.pmod(F.xxhash64("block", F.lit(9)), F.col("parts")))
    side = materialize(dealt.groupBy("label", "dim", "part", "parts").agg(*[F.collect_list(x).alias(y) for x, y in (("block", "k"), ("component", "c"), ("radius", "r"))], F.flatten(F.collect_list("centre")).alias("x")), "sides")
    wide = side.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
    far = side.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("part").alias("p"), *[F.col(c).alias(f"{c}2") for c in "kcrx"])
    met = wide.join(far, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("other") == F.col("p"))).select("dim", "k", "c", "r", "x", "k2", "c2", "r2", "x2", (F.col("part") == F.col("other")).alias("same"))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                k, c, r, k2, c2, r2 = (at[n].values.to_numpy() for n in ("k", "c", "r", "k2", "c2", "r2"))
                sims = at["x"].values.to_numpy().reshape(len(k), -1) @ at["x2"].values.to_numpy().reshape(len(k2), -1).T
                i, j = np.nonzero(sims >= np.cos(min(np.pi, reach + r.max() + r2.max())))
                fit = (c[i] != c2[j]) & (np.arccos(np.clip(sims[i, j], -1, 1)) <= reach + r[i] + r2[j])
                if at["same"].as_py():
                    fit &= i < j
                yield pa.RecordBatch.from_arrays([pa.array(k[i[fit]]), pa.array(k2[j[fit]])], ["k", "k2"])

    pairs = materialize(met.mapInArrow(allowed, "k long, k2 long"), "allowed")
    one = blocks.select(F.col("block").alias("k"), "dim", F.col("component").alias("a"), "v")
    two = blocks.select(F.col("block").alias("k2"), F.col("component").alias("b"), F.col("v").alias("v2"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_pylist()
            keep = [bool((unit(v, d) @ unit(v2, d).T >= threshold).any()) for v, v2, d in zip(batch.column("v"), batch.column("v2"), dims, strict=True)]
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    return pairs.join(one, "k").join(two, "k2").select("a", "b", "dim", "v", "v2").mapInArrow(linked, "a long, b long").distinct()


def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``roots`` (node, component) after the components of ``pairs`` (a, b) became one."""
    merged = components(pairs).select(F.col("node").alias("old"), F.col("component").alias("new"))
    own = merged.select(F.col("old").alias("node"), F.col("old").alias("component")).join(roots.select("node"), "node", "left_anti")
    return materialize(roots.unionByName(own).join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")), "roots")


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): for each node, the vectors of other nodes in its component that it links with, copies counted."""
    sizes = roots.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("parts"))
    placed = roots.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
    rows = placed.join(nodes.select("node", "vec", "copies"), "node")
    blocks = materialize(rows.groupBy("component", "part", "parts").agg(F.collect_list("node").alias("m"), F.collect_list("copies").alias("c"), F.flatten(F.collect_list("vec")).alias("v")), "blocks")
    wide = blocks.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
    side = blocks.select(F.col("component").alias("k"), F.col("part").alias("p"), F.col("m").alias("m2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    both = wide.join(side, (F.col("component") == F.col("k")) & (F.col("other") == F.col("p"))).select("m", "c", "v", "m2", "c2", "v2", (F.col("part") == F.col("other")).alias("same"))

    def matrix(v: pa.Scalar, n: int) -> np.ndarray:
        x = v.values.to_numpy().astype(np.float64).reshape(n, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m, c, v, m2, c2, v2 = (batch.column(x)[k] for x in ("m", "c", "v", "m2", "c2", "v2"))
                m, c, m2, c2 = (x.values.to_numpy() for x in (m, c, m2, c2))
                near = matrix(v, len(m)) @ matrix(v2, len(m2)).T >= threshold
                if batch.column("same")[k].as_py():
                    np.fill_diagonal(near, False)
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(near @ c2)], ["node", "linked"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m, m2])), pa.array(np.concatenate([near @ c2, c @ near]))], ["node", "linked"])

    return both.mapInArrow(counts, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def audit(nodes: DataFrame, roots: DataFrame, linked: DataFrame, threshold: float) -> float:
    """The least recall of a class of nodes by their true links, as a mean over its nodes, against all rows."""
    sizes = roots.groupBy("component").agg(F.count("*").alias("n"))
    level = F.coalesce(F.floor(F.log2("n")), F.lit(0)).cast("int")
    placed = nodes.select("node").join(roots.join(sizes, "component").select("node", "n"), "node", "left").select("node", level.alias("level"))
    placed = materialize(placed, "levels")
    totals = {x["level"]: x["n"] for x in placed.groupBy("level").agg(F.count("*").alias("n")).collect()}
    first = None
    for k in totals:
        part = placed.filter(F.col("level") == k).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(AUDIT)
        first = part if first is None else first.unionByName(part)
    if first is None:
        return 1.0
    chosen = nodes.select("node", "label", "dim", "vec").join(first, "node").collect()
    levels = {x["node"]: x["level"] for x in chosen}
    seen = {k: sum(v == k for v in levels.values()) for k in totals}
    kinds = {k: ([r["node"] for r in chosen if (r["label"], r["dim"]) == k], np.array([r["vec"] for r in chosen if (r["label"], r["dim"]) == k], dtype=np.float64)) for k in {(r["label"], r["dim"]) for r in chosen}}
    kinds = {k: (np.array(i), v / np.linalg.norm(v, axis=1, keepdims=True)) for k, (i, v) in kinds.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for kind in set(groups) & set(kinds):
                part = batch.filter(pa.array([g == kind for g in groups]))
                ids, x = kinds[kind]
                near = x @ _matrix(part.column("vec")).T >= threshold
                near &= ids[:, None] != part.column("node").to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ part.column("copies").to_numpy())], ["node", "true"])

    true = nodes.select("node", "label", "dim", "vec", "copies").mapInArrow(compare, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    held: dict[int, list[float]] = {}
    for x in true.join(linked, "node", "left").select("node", "true", F.coalesce("linked", F.lit(0)).alias("linked")).filter(F.col("true") > 0).collect():
        weight = totals[levels[x["node"]]] / seen[levels[x["node"]]]
        sums = held.setdefault(x["true"].bit_length(), [0.0, 0.0])
        sums[0] += weight * min(x["true"], x["linked"]) / x["true"]
        sums[1] += weight
    return min((found / of for found, of in held.values()), default=1.0)


def deduplicate(embeddings: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall: a row for each vector."""
    vectors = embeddings.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec"), F.col(label).alias("label"))
    nodes = nodes_of(vectors)
    graph = neighbour_graph(nodes, 17)
    roots = materialize(components(graph.filter(F.col("sim") >= threshold).select("a", "b")), "roots")
    part, full = enlarge(graph, nodes, roots, threshold)
    roots = joined(roots, bridges(nodes.join(full, "node", "left_semi"), roots, threshold).unionByName(across(part, roots, threshold)))
    linked = materialize(count_links(nodes, roots, threshold), "linked")
    recall = audit(nodes, roots, linked, threshold)
    if recall < RECALL:
        roots = joined(roots, bridges(nodes, roots, threshold))
        linked = materialize(count_links(nodes, roots, threshold), "linked")
        recall = audit(nodes, roots, linked, threshold)
        if recall < RECALL:
            raise RuntimeError(f"recall {recall:.4f} of links after the exact comparison")
    rooted = nodes.select("node", "copies", "id").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    known = rooted.join(least, "root").join(linked, "node", "left").select(F.col("node").alias("n"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("links"), "component_id")
    rows = vectors.select("id", F.xxhash64("label", "vec").alias("node"), (F.col("label").isNotNull() & F.col("vec").isNotNull()).alias("usable"))
    out = rows.join(known, (F.col("node") == F.col("n")) & F.col("usable"), "left")
    component = F.when(F.col("n").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), F.lit(round(recall, 6)).alias("audited_recall"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept,
       CAST(1 AS DOUBLE) AS audited_recall -- all links are here
FROM v LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
