"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits at random hyperplanes, one direction for each level. The forest is fitted on a bounded sample (``SAMPLE``
vectors): a node's threshold is the one that leaves the fewest pairs to compare on both sides, spilled vectors
included, and a node that no threshold would thin out (a dense group) stays a leaf. Below the depth that the sample reaches, the
median of the level's direction splits. A vector near a threshold spills to both sides; the margin follows from the spread of the
projected difference of two linked vectors. Every vector is led down every tree, as deep as the number of vectors of its label asks,
and vectors that share a leaf, a label and a length are compared by cosine in double precision. A pair counts in the first
leaf that both share only, so that links are counted per leaf without a list of pairs. Equal vectors of a label are one entry
with a count.

A leaf above ``LEAF_MOST`` entries, such as one dense group, is dealt to blocks, and pairs of blocks are compared in
tasks of their own. Nothing is capped. Output of a leaf is one row for each vector: its links and its group there.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or has a null label, links
with nothing; vectors of different lengths are not compared; repeated rows are equal vectors; an id that is null is kept
and names a group only where no other id does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import components, written

COSINE = 0.93
TREES = 6
LEAF = 256  # vectors of a leaf that trees aim at
LEAF_MOST = 4096
SAMPLE = 10_000
FITTED = 32  # vectors of the sample that a fitted node has at least
SPLIT_GAIN = 0.8  # a split must leave at most this share of the pairs
SPILL = 0.5  # margin, in standard deviations of the projected difference of two vectors at the threshold
BLOCK = 1024
COLUMNS = 2048  # leaves tested at once
MOST_DEPTH = 40


class Forest:
    """Directions by tree and level; thresholds of the nodes that the sample reaches (NaN: the node is a leaf)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, cosine: float, spill: float, seed: int = 7):
        dims = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, max(depth, 1), dims))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.margin = spill * math.sqrt(2 * (1 - cosine) / dims)
        self.thresholds: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.medians = np.zeros((trees, max(depth, 1)))
        for tree in range(trees):
            levels, members = [], {1: np.arange(len(sample))}
            projected = sample @ self.directions[tree].T
            self.medians[tree] = np.median(projected, axis=0)
            for level in range(depth):
                names, cuts, below = [], [], {}
                for node, own in members.items():
                    if len(own) >= FITTED:
                        names.append(node)
                        cuts.append(self._cut(projected[own, level]))
                        if not math.isnan(cuts[-1]):
                            left = projected[own, level] < cuts[-1]
                            below[2 * node], below[2 * node + 1] = own[left], own[~left]
                order = np.argsort(np.array(names, np.int64))
                levels.append((np.array(names, np.int64)[order], np.array(cuts, np.float64)[order]))
                members = below
            self.thresholds.append(levels)

    def _cut(self, values: np.ndarray) -> float:
        values = np.sort(values)
        count = len(values)
        choices = values[np.unique(np.linspace(0.1 * count, 0.9 * count, 33).astype(int))]
        left = np.searchsorted(values, choices + self.margin) / count
        right = 1 - np.searchsorted(values, choices - self.margin) / count
        pairs = left**2 + right**2
        best = int(pairs.argmin())
        return float(choices[best]) if pairs[best] <= SPLIT_GAIN else math.nan

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, leaf id) of every leaf that a vector reaches, ordered by both; ``depth`` bounds the way of each vector."""
        numbers, leaves = [], []
        for tree, levels in enumerate(self.thresholds):
            projected = x @ self.directions[tree].T
            number, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level, (names, cuts) in enumerate(levels):
                cut = np.full(len(node), self.medians[tree, level])
                if len(names):
                    place = np.minimum(np.searchsorted(names, node), len(names) - 1)
                    cut = np.where(names[place] == node, cuts[place], cut)
                ends = np.isnan(cut) | (depth[number] <= level)
                numbers.append(number[ends])
                leaves.append(node[ends] + (np.int64(tree) << 48))
                number, node, cut = number[~ends], node[~ends], cut[~ends]
                offset = projected[number, level] - cut
                left, right = offset < self.margin, offset >= -self.margin
                number, node = np.r_[number[left], number[right]], np.r_[node[left] * 2, node[right] * 2 + 1]
            numbers.append(number)
            leaves.append(node + (np.int64(tree) << 48))
        number, leaf = np.concatenate(numbers), np.concatenate(leaves)
        order = np.lexsort((leaf, number))
        return number[order], leaf[order]


def _root_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the groups of each pair; a group is named by its first member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (label[label] != label).any():
            label = label[label]


def _met(earlier: list[np.ndarray], a: range, b: range) -> np.ndarray:
    """Which pairs of the two blocks share an earlier leaf."""
    met = np.zeros((len(a), len(b)), bool)
    one, two = [np.concatenate([earlier[k] for k in part]) for part in (a, b)]
    known = np.intersect1d(one, two)
    rows = [np.repeat(np.arange(len(part)), [len(earlier[k]) for k in part]) for part in (a, b)]
    for begin in range(0, len(known), COLUMNS):
        columns = known[begin : begin + COLUMNS]
        sides = []
        for own, row, part in ((one, rows[0], a), (two, rows[1], b)):
            place = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
            inside = columns[place] == own
            side = np.zeros((len(part), len(columns)), np.float32)
            side[row[inside], place[inside]] = 1
            sides.append(side)
        if (sides[0].all(0) & sides[1].all(0)).any():
            return np.ones_like(met)
        met |= sides[0] @ sides[1].T > 0
    return met


def _compared(cosine: float, raw: type):
    def compare(group: pa.Table) -> pa.Table:
        entry = group.column("entry").to_numpy()
        copies = group.column("copies").to_numpy().astype(np.int64)
        side = group.column("side").to_numpy()
        one_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), raw).reshape(len(entry), -1).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        earlier = [np.frombuffer(v, np.int64) for v in group.column("earlier").to_pylist()]
        links, label = np.zeros(len(entry), np.int64), np.arange(len(entry))
        for begin in range(0, len(entry), BLOCK):
            a = range(begin, min(begin + BLOCK, len(entry)))
            for start in range(begin, len(entry), BLOCK):
                b = range(start, min(start + BLOCK, len(entry)))
                near = x[a.start : a.stop] @ x[b.start : b.stop].T >= cosine
                if begin == start:
                    near = np.triu(near, 1)
                if not one_block:
                    near &= side[a.start : a.stop, None] != side[None, b.start : b.stop]
                if near.any():  # pairs that an earlier leaf holds too are counted and joined there
                    near &= ~_met(earlier, a, b)
                i, j = np.nonzero(near)
                if len(i):
                    label = _root_links(label, i + begin, j + start)
                    links[a.start : a.stop] += near @ copies[b.start : b.stop]
                    links[b.start : b.stop] += near.T @ copies[a.start : a.stop]
        linked = links > 0
        return pa.table({"entry": entry[linked], "links": links[linked], "root": entry[label[linked]]})

    return compare


def linked(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, spill: float = SPILL, leaf_most: int = LEAF_MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & (norm > 0), F.lit(False)))
    key = F.when(F.col("usable"), F.xxhash64("label", "embedding"))
    rows = rows.withColumn("entry", key)
    entries = written(
        rows.filter("usable").groupBy("entry").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
        ).withColumn("dims", F.size("embedding"))
    )
    raw = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    parts = []
    for size in [r["dims"] for r in entries.select("dims").distinct().collect()]:  # the lengths of vectors in use
        own = entries.filter(F.col("dims") == size)
        depths = written(own.groupBy("label").agg(F.ceil(F.log2(F.greatest(F.count("*") / leaf, F.lit(1.0)))).cast("int").alias("depth")))
        deepest = min(MOST_DEPTH, depths.agg(F.max("depth")).first()[0])
        # a bounded sample fits the thresholds; it is chosen by hash
        chosen = own.orderBy(F.xxhash64("entry"), "entry").limit(sample).select(F.col("embedding").cast("array<float>").alias("e")).toArrow()
        points = np.asarray(chosen.column("e").combine_chunks().flatten(), np.float64).reshape(chosen.num_rows, size)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast(Forest(points, deepest, trees, cosine, spill))

        def lead(batches, sent=sent, size=size):
            for whole in batches:
                for begin in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(begin, BLOCK)
                    x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, size)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    number, leaves = sent.value.leaves(unit, batch.column("depth").to_numpy())
                    first = np.searchsorted(number, np.arange(len(x)))
                    data = [v.tobytes() for v in x.astype(raw)]
                    rows = pa.array(number)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(rows) for c in ("entry", "copies", "label")], pa.array(leaves),
                            pa.array([leaves[first[n] : k].tobytes() for k, n in enumerate(number)], pa.binary()), pa.array(data, pa.binary()).take(rows),
                        ],
                        ["entry", "copies", "label", "leaf", "earlier", "vector"],
                    )

        kind = f"entry long, copies long, label {own.schema['label'].dataType.simpleString()}, leaf long, earlier binary, vector binary"
        led = written(own.join(depths, "label").select("entry", "copies", "label", "embedding", "depth").mapInArrow(lead, kind))
        # leaves above the bound are few; written, their size is known, and only a small table is broadcast
        full = written(led.groupBy("label", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_most))
        dealt = led.join(full, ["label", "leaf"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / leaf_most), F.lit(1)).cast("int"))
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "blocks", "n")
        parts.append(dealt.groupBy("label", "leaf", "i", "j").applyInArrow(_compared(cosine, raw), "entry long, links long, root long"))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = written(found)
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("entry").alias("a"), F.col("root").alias("b")))
    named = entries.select("entry", "least", "copies").join(links, "entry", "left").join(roots.select(F.col("node").alias("entry"), "root"), "entry", "left")
    named = named.select("entry", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "entry").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("entry", "n_links", "component_id")
    out = rows.select("vec_id", "entry").join(named, "entry", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
