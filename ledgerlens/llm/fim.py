"""Operator 13: fill-in-the-middle by cuts found in an indexable skip list.

A text is a sequence of units (a run of ASCII letters, or one other code
point).  A skip list over the unit boundaries has express lanes in which every
link carries two widths: the units and the code points it passes.  Going down
the lanes with the accumulated unit widths reaches a boundary's rank exactly;
the accumulated code point widths then say where to cut the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of the texts that are rearranged, and of these the share that
#: starts with the suffix.
REARRANGED = 90
SUFFIX_FIRST = 20
SEED = 1
#: A node is in the next higher lane with probability 2 ** -LANE_BITS.
LANE_BITS = 3
#: Code points decoded at once, so scratch arrays stay small.
SLICE_CHARS = 1 << 20

FORM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> np.ndarray:
    """The code point after each unit of ``text``."""
    found = []
    for lo in range(0, len(text), SLICE_CHARS):
        piece = text[lo:lo + SLICE_CHARS + 1]                 # one more: does the last run go on?
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
        size = min(SLICE_CHARS, len(points))
        after = np.zeros(size, bool)
        after[:len(points) - 1] = letter[1:size + 1]
        found.append(np.flatnonzero(~(letter[:size] & after)) + (lo + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class SkipList:
    """Boundaries 0 to n of a text of n units, in lanes.

    The lowest lane links each boundary to the next one.  Boundary 0, the
    head, is in every lane; another one climbs a lane further as long as the
    next ``LANE_BITS`` bits of the hash of its number are 0.  ``units`` and
    ``points`` are the widths of a lane's links, ``below`` says where each of
    its nodes stands in the lane underneath.
    """

    def __init__(self, ends: np.ndarray):
        self.size = len(ends)
        nodes = np.arange(self.size + 1, dtype=np.int64)
        places = np.concatenate([np.zeros(1, np.int64), ends.astype(np.int64)])
        bits = mix(nodes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        lane_mask = np.uint64((1 << LANE_BITS) - 1)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = nodes
        while True:
            self.lanes.append((np.diff(nodes), np.diff(places), below))
            climbs = (bits & lane_mask) == 0
            climbs[0] = True
            below = np.flatnonzero(climbs)
            if len(below) <= 1:
                break
            nodes, places, bits = nodes[below], places[below], bits[below] >> np.uint64(LANE_BITS)

    def point(self, rank: int) -> int:
        """The code point at which the boundary after ``rank`` units stands."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        at = passed = point = 0
        for units, points, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                point += int(points[at])
                at += 1
            at = int(below[at])
        return point


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document: the first four groups of
    eight hex digits of the SHA-256 of ``seed:doc_id`` (null: ``seed:``)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def transform(text: str, doc_id: int | None, seed: int = SEED, rearranged: int = REARRANGED,
              suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= rearranged or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
    lanes = SkipList(ends)
    first, second = (lanes.point(rank) for rank in ranks)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(seed: int, rearranged: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [transform(t.as_py() or "", i, seed, rearranged, suffix_first)
                    for t, i in zip(batch.column("text"), ids, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rearranged: int = REARRANGED,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form (``plain``,
    ``psm`` or ``spm``), prefix_chars and middle_chars (code points; null if
    plain) and the output text.

    A null text counts as empty; empty texts and texts that hold a marker
    stay plain.  The draws depend on doc_id alone, so repeated rows give
    repeated results and all rows without an id share their draws.  Other
    columns are ignored, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_transform(seed, rearranged, suffix_first), FORM)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` started from.

    A rearranged text held no marker, and a marker can't arise where a part
    meets one, so the three markers split the output exactly.
    """
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
             .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))
