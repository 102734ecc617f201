"""Operator 5: packing documents into sequences by bin completion.

A document's ids end with one separator id.  Longer documents are cut into
full sequences, their first piece taking the remainder.  Pieces are dealt at
random, repeated rows too, to shards of about ``SHARD`` pieces; each shard is
packed on its own by bin completion: starting from the best-fit-decreasing solution, a
depth-first search takes the largest piece left, enumerates the undominated
fillings of the space beside it (some full ones first, then all by a subset
search, step by step as they are needed) and gives up a branch as soon
as the space it wasted exceeds what a solution with the sought number of
sequences may waste.  The search of a shard ends at the lower bound
(``lower_bound``: no fewer sequences can hold the pieces), when it is
exhausted, or after ``nodes`` steps (bins and steps of the subset search) for
a sought number of sequences, with the best solution so far; with
``nodes=None`` it runs to the end, and the shard's number is the least.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import encoder

CAPACITY = 2048
SHARD = 4096
NODES = 3_000
WIDEST = 12                     # leading fillings, tried before the subset search

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []             # (space left, bin), sorted
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([size])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(size)
            insort(room, (left - size, k))
    return bins


class _Stock:
    """Sizes left to pack, with counts; the distinct sizes stay sorted."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.kinds = sorted(self.count)

    def take(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            self.count[s] -= 1
            if not self.count[s]:
                del self.kinds[bisect_left(self.kinds, s)]

    def give(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            if not self.count[s]:
                insort(self.kinds, s)
            self.count[s] += 1

    def largest(self, most: int, taken: Sequence[int] = ()) -> int:
        """The largest size up to ``most`` that is left beside ``taken`` (0: none)."""
        at = bisect_right(self.kinds, most) - 1
        while at >= 0 and self.count[self.kinds[at]] <= taken.count(self.kinds[at]):
            at -= 1
        return self.kinds[at] if at >= 0 else 0


def leading(stock: _Stock, room: int) -> list[tuple[int, ...]]:
    """Full fillings of ``room`` that are quick to find, fullest first, at most WIDEST."""
    first = stock.largest(room)
    if not first:
        return [()]
    if first == room:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {}
    at = bisect_right(stock.kinds, room)
    for a in reversed(stock.kinds[max(0, at - 4 * WIDEST):at]):
        b = stock.largest(min(a, room - a), (a,))
        parts: tuple[int, ...] = (a, b) if b else (a,)
        while b and (c := stock.largest(min(parts[-1], room - sum(parts)), parts)):
            parts += (c,)
        if len(parts) > 1 and a < first and sum(parts) <= first:
            continue                             # fits into the single largest size
        found[parts] = sum(parts)
        if found[parts] == room:
            break
    return sorted(found, key=lambda p: (-found[p], len(p), [-x for x in p]))[:WIDEST]


def _dominated(stock: _Stock, parts: list[int], left: int) -> bool:
    """A size beside ``parts`` fits into the space ``left``, or can take the
    place of one smaller part or of two parts that fit into it."""
    if stock.largest(left, parts):
        return True
    kinds = sorted(set(parts))
    if left and any(stock.largest(s + left, parts) > s for s in kinds):
        return True
    pairs = ((a, b) for k, a in enumerate(kinds) for b in kinds[k:] if a < b or parts.count(a) > 1)
    return any(stock.largest(a + b + left, parts) >= a + b for a, b in pairs)


def fillings(stock: _Stock, room: int, slack: int) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``room`` that leaves at most ``slack``, the
    leading ones first; None for each other step of the subset search, so that
    the caller can count it.  ``stock`` must be the same at each step."""
    early = leading(stock, room)
    yield from (f for f in early if room - sum(f) <= slack)
    if early in ([()], [(room,)]):
        return                                   # nothing fits, or one size fits exactly
    parts: list[int] = []
    left = most = room
    while True:
        size = stock.largest(min(most, left), parts)
        if size:
            parts.append(size)
            left, most = left - size, size
            yield None
            continue
        whole = left <= slack and tuple(parts) not in early and not _dominated(stock, parts, left)
        yield tuple(parts) if whole else None
        if not parts:
            return
        left, most = left + parts[-1], parts.pop() - 1


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins: the tokens' bound, raised for every small size
    k by what the pieces over capacity / 2 leave unusable.

    Pieces over half take a bin each; one over capacity - k shares it with no
    piece of k or more, the others leave their space to the pieces from k to
    half, and what that space can't take needs bins of its own.
    """
    order = np.sort(np.asarray(sizes, np.int64))
    if not len(order):
        return 0
    sums = np.concatenate([[0], np.cumsum(order)])
    half = int(np.searchsorted(order, capacity // 2, side="right"))       # pieces up to half come before
    small = np.concatenate([[0], np.unique(order[:half])])
    start = np.searchsorted(order, small, side="left")
    wide = np.searchsorted(order, capacity - small, side="right")         # pieces over capacity - k come from here
    space = (wide - half) * capacity - (sums[wide] - sums[half])
    over = np.maximum(sums[half] - sums[start] - space, 0)
    return int((len(order) - half + -(-over // capacity)).max())


def bin_completion(sizes: list[int], capacity: int, nodes: int | None = NODES) -> list[list[int]]:
    """Bins of at most ``capacity`` holding ``sizes`` (each in 1..capacity)."""
    sizes = sorted(sizes, reverse=True)
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = lower_bound(sizes, capacity)
    nodes = math.inf if nodes is None else nodes
    for goal in range(bound, len(best)):
        allowed = goal * capacity - total
        stock = _Stock(sizes)
        bins: list[tuple[int, ...]] = []
        wasted = [0]
        choices: list[tuple[int, Iterator[tuple[int, ...] | None]]] = []
        spent = 0
        while spent < nodes:
            spent += 1
            if not stock.kinds:
                return [list(b) for b in bins]
            top = stock.kinds[-1]
            choices.append((top, fillings(stock, capacity - top, allowed - wasted[-1])))
            pick = None
            while choices and pick is None:
                top, options = choices[-1]
                stock.take((top,))
                for found in options:
                    if found is not None:
                        pick = (top, *found)
                        break
                    spent += 1
                    if spent >= nodes:
                        break
                stock.give((top,))
                if spent >= nodes:
                    break
                if pick is None:                 # no branch left here: take back a bin
                    choices.pop()
                    if bins:
                        stock.give(bins.pop())
                        wasted.pop()
            if pick is None:
                break
            stock.take(pick)
            bins.append(pick)
            wasted.append(wasted[-1] + capacity - sum(pick))
    return best


def _pieces(capacity: int, separator: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path), separator.to_bytes(4, "little")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, lo, hi - lo, zlib.crc32(ids[4 * lo:4 * hi])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def _pack(capacity: int, nodes: int | None):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        full = int(np.searchsorted(-lengths, -capacity, side="right"))
        bins = bin_completion(lengths[full:].tolist(), capacity, nodes)
        place: dict[int, list[tuple[int, int]]] = {}
        for k, sizes in enumerate(bins):
            at = 0
            for size in sizes:
                place.setdefault(size, []).append((full + k, at))
                at += size
        where = [(k, 0) for k in range(full)] + [place[int(n)].pop() for n in lengths[full:]]
        shard = table.column("shard").to_numpy().astype(np.int64)
        sequence, offset = np.array(where, np.int64).reshape(-1, 2).T
        return (table.drop_columns(["shard"]).append_column("sequence_id", pa.array(shard * 2**32 + sequence))
                .append_column("offset", pa.array(offset)))
    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(capacity, separator, path), PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, path: str | None = None,
         nodes: int | None = NODES) -> DataFrame:
    """Packs all ``docs`` (doc_id, text, any other columns) into sequences.

    Returns one row per piece: doc_id, piece, start (ids before it in its
    document), length, ids_crc32 (of its ids as little-endian uint32),
    sequence_id and offset (its place; the pieces of a sequence follow each
    other without gaps from 0).  A null or empty text is the separator alone;
    repeated rows and null ids are packed like any other; an empty table
    gives no rows.  ``path`` names the vocabulary file, ``nodes`` the steps of
    the search (None: to the end).
    """
    cut = materialize(pieces(docs, capacity, separator, path), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    row = F.monotonically_increasing_id()        # of a written table: the same for a repeated task
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", row), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity, nodes), PACKED)
