"""Operator 11: ranked lexical search by an exact sparse ball tree.

A document is a sparse vector of integer impacts, one per query term it
holds; an item's score is the inner product with the 0/1 vector of its terms.
Documents are read in shards of bounded size.  Each shard becomes a ball tree:
a node has the centroid of its documents and the radius around it, which bound
every inner product below it.  Nodes are visited best-first; a subtree whose
bound, rounded up, can't reach the score wanted is never opened.  Leaves add
up the integers themselves.

Items are taken in blocks of bounded size.  A task carries the best documents
of every item from shard to shard, so later shards are pruned harder, and
gives only these to the shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textops import mix

TOP = 10
#: Bounds of a block of items, which is sent to the tasks: rows and text bytes
#: (on average over the blocks; a longer item makes its own block longer).
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 16 << 20
#: Documents of a shard and of a leaf; directions that documents are split by.
SHARD_DOCS = 8_192
LEAF_DOCS = 64
DIRECTIONS = 16
#: Relative slack of the bounds, far above the rounding of sums of a shard.
SLACK = 1e-9

#: Bytes of a term stay (A-Z in lower case), the others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, item_id long, doc_id long, score long"
_LAST = 1 << 63                      # a null id stands behind all others


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of
    non-ASCII characters, only A-Z in lower case."""
    return text.translate(_TERMS).split() if text else []


def _count(vocabulary: dict[bytes, int]):
    """Per document its number of terms, and the query terms with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                held = Counter(words)
                known = sorted((vocabulary[w], held[w]) for w in held.keys() & vocabulary.keys())
                terms.append([t for t, _ in known])
                counts.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])
    return run


def weight(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class BallTree:
    """Sparse vectors of non-negative integers (``terms`` and ``values``, rows
    ``offsets``; no row empty) under balls.

    Rows are put into the tree's order (``order``), so every node is a range
    of rows.  A node is split at the median along the line between two far
    points; the points are seen in a few hashed directions, which decide how
    well the tree prunes, not what it finds.
    """

    def __init__(self, terms: np.ndarray, values: np.ndarray, offsets: np.ndarray, leaf: int = LEAF_DOCS):
        sizes = np.diff(offsets)
        n = len(sizes)
        rows = np.repeat(np.arange(n), sizes)
        hashed = mix(terms.astype(np.uint64) + np.uint64(1))
        sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
        place = rows * DIRECTIONS + (hashed % np.uint64(DIRECTIONS)).astype(np.int64)
        seen = np.bincount(place, weights=values * sign, minlength=n * DIRECTIONS).reshape(n, DIRECTIONS)
        self.order = np.arange(n)
        self.nodes: list[tuple[int, int, int]] = []       # first row, row after the last, first child (0: leaf)
        self._split(seen, leaf)
        sizes = sizes[self.order]
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        moved = np.repeat(offsets[:-1][self.order] - self.offsets[:-1], sizes) + np.arange(self.offsets[-1])
        self.terms, self.values = terms[moved], values[moved]
        squares = np.add.reduceat(self.values.astype(float) ** 2, self.offsets[:-1]) if n else np.zeros(0)
        self.balls = [self._ball(lo, hi, squares) for lo, hi, _ in self.nodes]

    def _split(self, seen: np.ndarray, leaf: int) -> None:
        self.nodes.append((0, len(self.order), 0))
        at = 0
        while at < len(self.nodes):
            lo, hi, _ = self.nodes[at]
            if hi - lo > leaf:
                here = self.order[lo:hi]
                points = seen[here]
                a = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                b = points[((points - a) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                self.order[lo:hi] = here[np.argpartition(points @ (b - a), middle)]
                self.nodes[at] = (lo, hi, len(self.nodes))
                self.nodes += [(lo, lo + middle, 0), (lo + middle, hi, 0)]
            at += 1

    def _ball(self, lo: int, hi: int, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Centroid (terms and values) and a radius that is never too small."""
        cut = slice(self.offsets[lo], self.offsets[hi])
        known, inverse = np.unique(self.terms[cut], return_inverse=True)
        values = self.values[cut].astype(float)
        centroid = np.bincount(inverse, weights=values, minlength=len(known)) / max(1, hi - lo)
        if hi <= lo:
            return known, centroid, 0.0
        inner = np.add.reduceat(values * centroid[inverse], self.offsets[lo:hi] - self.offsets[lo])
        square = float((centroid ** 2).sum())
        far = squares[lo:hi] - 2 * inner + square
        slack = SLACK * (squares[lo:hi] + 2 * inner + square)
        return known, centroid, math.sqrt(float(np.maximum(far + slack, 0).max())) * (1 + SLACK)

    def bound(self, node: int, query: np.ndarray) -> int:
        """No row under ``node`` has a larger inner product with ``query`` (sorted terms)."""
        known, centroid, radius = self.balls[node]
        at = np.searchsorted(known, query)
        at[at == len(known)] = 0
        inner = float(centroid[at][known[at] == query].sum()) if len(known) else 0.0
        return math.floor((inner + math.sqrt(len(query)) * radius) * (1 + SLACK)) + 1

    def scores(self, node: int, wanted: np.ndarray) -> np.ndarray:
        """Inner products of a leaf's rows; ``wanted`` marks the query's terms."""
        lo, hi, _ = self.nodes[node]
        cut = slice(self.offsets[lo], self.offsets[hi])
        return np.add.reduceat(np.where(wanted[self.terms[cut]], self.values[cut], 0), self.offsets[lo:hi] - self.offsets[lo])

    def search(self, query: np.ndarray, wanted: np.ndarray, keys: np.ndarray, best: list[tuple[int, int]], top: int) -> int:
        """Puts the rows with the ``top`` largest positive scores into
        ``best``, a heap of (score, -key); of equal scores the smaller key
        wins.  Returns the number of leaves that were read."""
        if not len(self.order) or not len(query):
            return 0
        read, open_nodes = 0, [(-self.bound(0, query), 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            least = best[0][0] if len(best) == top else 1
            if -bound < least:
                break
            lo, hi, child = self.nodes[node]
            if child:
                for c in (child, child + 1):
                    if (reach := self.bound(c, query)) >= least:
                        heapq.heappush(open_nodes, (-reach, c))
                continue
            read += 1
            found = self.scores(node, wanted)
            for k in np.flatnonzero(found >= least):
                entry = (int(found[k]), -int(keys[self.order[lo + k]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return read


def _find(items: Sequence[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        wanted = np.zeros(len(weights), bool)
        for whole in batches:
            for start in range(0, whole.num_rows, SHARD_DOCS):
                batch = whole.slice(start, SHARD_DOCS)
                lists = batch.column("terms")
                terms = lists.flatten().to_numpy().astype(np.int64)
                counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
                sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
                # 100 - 90 + 90 n N / L, in whole numbers of any size
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
                impact = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes)))
                ids = batch.column("doc_id").to_pylist()
                keys = np.array([_LAST if i is None else i for i in ids], object)
                tree = BallTree(terms, impact, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
                for (_, query), held in zip(items, best, strict=True):
                    wanted[query] = True
                    tree.search(query, wanted, keys, held, top)
                    wanted[query] = False
        rows = [(k, items[k][0], None if -key == _LAST else -key, score)
                for k, held in enumerate(best) for score, key in held]
        kinds = (("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)],
                                         names=[name for name, _ in kinds])
    return run


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    vectors = materialize(docs.mapInArrow(_count(vocabulary), VECTORS), "terms")
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():    # at most the block's terms
        df[r["term"]] = r["count"]
    weights = np.array([weight(totals["docs"], int(x)) for x in df], np.int64)
    queries = [(i, np.array(sorted({vocabulary[w] for w in words}), np.int64)) for i, words in items]
    found = vectors.where(F.size("terms") > 0).mapInArrow(_find(queries, weights, totals["docs"], totals["terms"], top), FOUND)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns
    are ignored.  A row of either table is a document or an item of its own,
    also if it repeats another one or has no id (item rows that share an id
    are each ranked under it).  Equal scores rank by doc_id, null last; among
    rows with one doc_id the order is arbitrary.  Null and empty texts have
    no terms: such an item finds nothing, nor does any item in an empty table.
    Scores of 0 are no results.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    size = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["rows"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    # written, so that a row keeps its block however often the table is read
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        rows = [(r["item_id"], sorted(set(terms_of(r["text"].encode() if r["text"] else None))))
                for r in items.where(F.col("block") == k).collect()]                   # a block's items
        rows = [r for r in rows if r[1]]
        if rows:
            found = found.unionByName(_search_block(docs, rows, top))
    return found
