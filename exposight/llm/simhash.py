"""SimHash near-duplicates: fingerprints within a bit distance, found with BK-trees.

Fingerprint: the majority of the XXH64 hashes of all word shingles, bit by bit. Equal fingerprints are collapsed
first. A distance of at most r changes at most r of ``blocks`` bit ranges, so two linked fingerprints agree on
``blocks - r`` of them: each fingerprint goes to one shard per choice of such ranges. In a shard a BK-tree is built
(children keyed by their bit distance to the parent) and searched along the edges within the radius. A shard with
more than ``TREE_ROWS`` fingerprints is cut into trees of that size, and each tree is sent to every block of the
shard's fingerprints that comes after it, so no task holds more than one tree and one block. Trees travel by shuffle:
no fingerprints pass through the driver.

A tree gives back a spanning forest of its links, not the links: a group of n near copies makes n - 1 rows.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; fewer
words than a shingle make one shingle of all; a null id takes part in links, but only as id null; repeated rows get
one row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.llm.batches import map_values
from exposight.llm.components import components
from exposight.session import materialise

SEED = 42
TREE_ROWS = 20_000  # fingerprints of a tree and of a block of queries
HASHES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 4_000_000  # of a query and a node, at most, in one step of a search


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    n = max(1, len(words) - shingle + 1)
    for start in range(0, n, HASHES_AT_ONCE):
        end = min(n, start + HASHES_AT_ONCE)
        runs = zip(*(words[start + k : end + k] for k in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs), dtype="<u8", count=end - start
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``, the fingerprint as a signed bigint."""

    def work(texts: list) -> list[tuple]:
        return [(int(np.uint64(fingerprint(t, shingle)).astype(np.int64)),) for t in texts]

    return map_values(docs, id_col, text_col, work, "fp bigint")


class Trees:
    """A BK-tree for each shard of a batch, built level by level with arrays.

    Values are sorted by shard; node i is value i. Children of a node are a range of ``edges``, sorted by
    (parent, distance)."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        self.roots = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, dtype=np.int64)
        group = np.repeat(np.arange(len(self.roots)), np.diff(np.r_[self.roots, n]))
        pending = np.setdiff1d(np.arange(n), self.roots, assume_unique=True)
        parent = self.roots[group[pending]]
        edges = []
        while len(pending):
            distance = np.bitwise_count(values[pending] ^ values[parent]).astype(np.int64)
            edge = parent * 65 + distance
            order = np.argsort(edge, kind="stable")
            pending, edge = pending[order], edge[order]
            first = np.r_[True, edge[1:] != edge[:-1]]
            child = pending[first]
            edges.append((edge[first], child))
            place = np.cumsum(first) - 1
            rest = ~first
            pending, parent = pending[rest], child[place[rest]]
        keys = np.concatenate([e for e, _ in edges]) if edges else np.zeros(0, dtype=np.int64)
        kids = np.concatenate([c for _, c in edges]) if edges else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys)
        self.edges, self.children = keys[order], kids[order]

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, node) within the radius; only edges that can hold one are followed."""
        asked, node = np.arange(len(queries)), root
        while len(asked):
            distance = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield asked[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            asked = np.repeat(asked, count)
            node = self.children[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]


class Forest:
    """Union-find over array positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def _tree_links(tree_shard, tree, query_shard, queries, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between trees and queries of the same shards."""
    if not len(tree):
        return tree, tree
    order = np.lexsort((tree, tree_shard))
    shards, values = tree_shard[order], tree[order]
    trees = Trees(shards, values)
    every = np.concatenate([values, queries])
    forest = Forest(len(every))
    roots = shards[trees.roots]
    place = np.searchsorted(roots, query_shard)
    has = (place < len(roots)) & (roots[np.minimum(place, len(roots) - 1)] == query_shard)
    index = np.flatnonzero(has)
    largest = int(np.diff(np.r_[trees.roots, len(values)]).max())
    at_once = min(1 << 16, max(64, PAIRS_AT_ONCE // largest))
    for start in range(0, len(index), at_once):
        part = index[start : start + at_once]
        for found, node in trees.search(queries[part], trees.roots[place[part]], radius):
            forest.join(part[found] + len(values), node)
    tied = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[tied], every[forest.root[tied]]


def link_forest(fps: DataFrame, radius: int, blocks: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Distinct ``fp`` → links ``a, b`` that connect exactly what the links within ``radius`` connect."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("agreed")) for i, m in enumerate(masks)
    ]))
    rows = fps.select("fp", shards.alias("s")).select(F.xxhash64("s.choice", "s.agreed").alias("shard"), "fp")
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialise(counts.select("shard", F.ceil(F.col("n") / tree_rows).alias("parts")), "simhash-shards")
    rows = rows.join(counts, "shard")
    # Part i of a shard is the tree for the queries of parts i, i + 1, ...: cells (tree part, query part).
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
    rows = rows.withColumn("part", part)
    as_tree = rows.select("shard", "fp", F.lit(True).alias("tree"), F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    as_query = rows.select("shard", "fp", F.lit(False).alias("tree"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("part"))).alias("i"), F.col("part").alias("j"))
    # Small shards share a cell of the grid, so that a batch holds many of them.
    cells = as_tree.unionByName(as_query).select(
        F.xxhash64("shard", "i", "j").alias("cell"), "tree", "fp",
    )

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def links(part: pd.DataFrame) -> pd.DataFrame:
            cell = part["cell"].to_numpy()
            values = part["fp"].to_numpy().view(np.uint64)
            tree = part["tree"].to_numpy(dtype=bool)
            a, b = _tree_links(cell[tree], values[tree], cell[~tree], values[~tree], radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:  # sorted by cell: a cell ends where the next begins
            held.append(batch)
            size += len(batch)
            last = batch["cell"].iloc[-1]
            if size >= 2 * tree_rows and held[0]["cell"].iloc[0] != last:
                rows = pd.concat(held)
                done = rows["cell"].to_numpy() != last
                yield links(rows[done])
                held = [rows[~done]]
                size = len(held[0])
        if size:
            yield links(pd.concat(held))

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(per_partition, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5,
    id_col: str = "doc_id", text_col: str = "text", tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (smallest id reachable by links)."""
    if blocks <= radius:
        raise ValueError("blocks must be more than radius")
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = components(link_forest(fps.select("fp"), radius, blocks, tree_rows))
    known = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialise(known.join(least, "component").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; all columns kept. Rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, **options)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped id")).distinct()
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col("dropped id"), "left_anti")
