"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors, the smallest by a hash
of their id): each node splits by the hyperplane between two of its vectors. Every
vector is then indexed in one leaf of each tree. A query walks all trees with one
priority queue, ordered by the squared margins on the way, until the leaves it has opened hold
a certain share of the sample. That share is calibrated: the least at which walks for
sample vectors find ``TARGET`` of their true neighbours in the sample. Vectors with
structure need a small one, vectors without any a large one. A query that has met fewer
than k rows goes on to all leaves of one tree, so it gets k rows wherever there are k. Queries and vectors meet
by (tree, leaf), in blocks of bounded size, and are ranked by exact distance.

Of equal vectors only the k + 1 smallest ids enter the index: at equal distance ties go
to smaller ids, so no other copy can be among the k nearest of any query, itself
excluded. That is exact for copies of any number.

Defined cases: vectors that are null, all zero, or hold null or non-finite components
take no part, nor do rows without an id; an id with several vectors is several
candidates and, if a query, is searched with all of them, the best score counting; vectors of another
length than the most frequent one take no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import shared

TREES = 16
LEAF = 512
SAMPLE = 20000
#: Share of the true neighbours that the walk must find for sample vectors, and how many of these are tried.
TARGET, TRIED = 0.95, 100
BLOCK = 4096


class Forest:
    """Trees as arrays: ``normal``, ``offset``, children (a leaf as ~number) and the sample's count per leaf."""

    def __init__(self, sample: np.ndarray, total: int, k: int = 10, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.fitted = len(sample)
        least = max(4, min(len(sample) // 16, int(leaf * len(sample) / max(1, total))))
        self.trees = [self._grow(sample, least, rng) for _ in range(trees)]
        self.share = self._calibrated(sample, k)

    @staticmethod
    def _grow(sample, least, rng):
        normals, offsets, children, sizes = [], [], [], []

        def grow(rows):
            if len(rows) > least:
                for _ in range(3):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    length = np.linalg.norm(normal)
                    if length > 0:
                        normal = normal / length
                        offset = float(normal @ (a + b) / 2)
                        right = sample[rows] @ normal > offset
                        if 0.05 < right.mean() < 0.95:
                            node = len(normals)
                            normals.append(normal)
                            offsets.append(offset)
                            children.append([0, 0])
                            children[node] = [grow(rows[~right]), grow(rows[right])]
                            return node
            sizes.append(len(rows))
            return ~(len(sizes) - 1)

        root = grow(np.arange(len(sample)))
        width = sample.shape[1]
        return (
            np.array(normals, np.float64).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes), root,
        )

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.trees)), np.int64)
        for t, (normals, offsets, children, _, root) in enumerate(self.trees):
            at = np.full(len(vectors), root, np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                nodes = at[inner]
                side = (vectors[inner] * normals[nodes]).sum(axis=1) > offsets[nodes]
                at[inner] = children[nodes, side.astype(np.int64)]
            out[:, t] = ~at
        return out

    def walk(self, query: np.ndarray):
        """(tree, leaf) pairs, the most promising first, from one queue over all trees."""
        queue = [(0.0, t, tree[4]) for t, tree in enumerate(self.trees)]
        margins = [tree[0] @ query - tree[1] for tree in self.trees]
        while queue:
            far, t, node = heapq.heappop(queue)
            children = self.trees[t][2]
            while node >= 0:
                margin = margins[t][node]
                side = int(margin > 0)
                heapq.heappush(queue, (far + margin * margin, t, int(children[node, 1 - side])))
                node = int(children[node, side])
            yield t, ~node

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """The leaves to open: their fitted counts add up to ``self.share`` of the sample."""
        opened, held = [], 0
        for t, leaf in self.walk(query):
            if held >= self.share * self.fitted:
                break
            opened.append((t, leaf))
            held += self.trees[t][3][leaf]
        return opened

    def everywhere(self, query: np.ndarray) -> list[tuple[int, int]]:
        """All leaves of one tree, which together hold every vector once."""
        return [(0, leaf) for leaf in range(len(self.trees[0][3]))]

    def _calibrated(self, sample: np.ndarray, k: int) -> float:
        """Share of the sample that walks must open to find ``TARGET`` of the k nearest of sample vectors."""
        leaves, needed = self.leaves(sample), []
        for i, query in enumerate(sample[:TRIED]):
            distance = ((sample - query) ** 2).sum(axis=1)
            distance[i] = np.inf
            missing = set(np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)].tolist())
            held = 0
            for t, leaf in self.walk(query):
                held += self.trees[t][3][leaf]
                found = [x for x in missing if leaves[x, t] == leaf]
                needed += [held] * len(found)
                missing.difference_update(found)
                if not missing:
                    break
        return float(np.quantile(needed, TARGET)) / len(sample) if needed else 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, as arrays of double."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    rows = cut_lineage(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common.d if common else 0))


def fit(vectors: DataFrame, sample: int = SAMPLE, **shape) -> Forest | None:
    total = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select(F.col("v").cast("array<float>").alias("v")).toArrow()["v"]
    # copies would count as found neighbours when the share is calibrated
    return Forest(np.unique(np.stack(rows.to_numpy()).astype(np.float64), axis=0), total, **shape) if total else None


def neighbours(queries: DataFrame, vectors: DataFrame, forest: Forest, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    ``queries`` and ``vectors`` hold (vec_id, v); a query is not its own candidate.
    """
    model = shared(vectors.sparkSession, forest)
    schema = f"id long, v {vectors.schema['v'].dataType.simpleString()}, tree int, leaf int"

    def matrix(column):
        return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)

    def rows_of(batch, row, tree, leaf):
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32())],
            names=["id", "v", "tree", "leaf"],
        )

    def index(batches):
        forest = model()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                leaves = forest.leaves(matrix(part.column(1)))
                n, trees = leaves.shape
                yield rows_of(part, np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n), leaves.ravel())

    def probes_by(search):
        def probe(batches):
            forest = model()
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    opened = [(i, t, leaf) for i, q in enumerate(matrix(part.column(1))) for t, leaf in search(forest, q)]
                    yield rows_of(part, *(np.array(x, np.int64) for x in zip(*opened)))

        return probe

    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "v")
    indexed = cut_lineage(kept.mapInArrow(index, schema), "index")
    sizes = lambda df, name: df.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def dealt(df, blocks, own, other, kind):
        rows = df.join(blocks, ["tree", "leaf"])
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        rows = rows.withColumns({own: block, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return rows.select("tree", "leaf", "vb", "qb", F.lit(kind).alias("query"), "id", "v")

    def rank(table):
        is_query = table["query"].to_numpy(zero_copy_only=False)
        q, x = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        out = []
        if q.num_rows and x.num_rows:
            ids = x["id"].to_numpy()
            block = matrix(x["v"].combine_chunks())
            for query, v in zip(q["id"].to_pylist(), matrix(q["v"].combine_chunks())):
                distance = np.sqrt(((block - v) ** 2).sum(axis=1))
                other = np.flatnonzero(ids != query)
                best = other[np.lexsort((ids[other], distance[other]))[:k]]
                out.append((np.full(len(best), query), ids[best], distance[best]))
        query, found, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    def best(queries, search):
        probes = cut_lineage(queries.select("vec_id", "v").mapInArrow(probes_by(search), schema), "probes")
        blocks = sizes(indexed, "vb").join(sizes(probes, "qb"), ["tree", "leaf"])
        met = dealt(indexed, blocks, "vb", "qb", False).unionByName(dealt(probes, blocks, "qb", "vb", True))
        found = met.groupBy("tree", "leaf", "vb", "qb").applyInArrow(rank, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = cut_lineage(best(queries, Forest.search), "near")
    # queries that met too few rows, as in tiny or lopsided tables, go on to all leaves of one tree, which hold every row
    wanted = min(k, indexed.filter("tree = 0").count())
    enough = found.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= wanted).select("vec_id")
    short = cut_lineage(queries.select("vec_id", "v").join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    rest = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return rest.unionByName(best(short, Forest.everywhere)).select("query_id", "rank", "vec_id", "score")
