"""Operator 1: near-duplicate groups by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles.  Its signature is
``SYMBOLS`` MinHash values of 16 bits each; two sets of similarity J differ
in about ``SYMBOLS * (1 - J)`` symbols.  The signature is cut into ``CHUNKS``
chunks.  By the pigeonhole principle, two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have a chunk with at most one differing symbol, so
indexing every chunk once per symbol left out (the allowed chunk errors,
enumerated on both sides) brings every such pair into a common bucket.

Buckets are joined without listing their pairs:

1. two star rounds tie each member to one member of its bucket that belongs
   to another group so far; a member takes its nearest candidate by
   signature, and the link is confirmed on the full sets;
2. members of buckets that still hold several groups meet anew by what their
   full sets share: of the shingles found in several groups, rarest first, a
   linked pair has one in common among the first few of both (see
   ``_prefixes``), so texts that share a passage but no link part here; a
   star round ties each of the new buckets to the member that lacks least;
3. members that may still link with another group of their bucket, by an
   upper bound of the similarity, are packed into blocks with their full
   sets, and blocks that meet in a bucket are compared by numpy (never two
   blocks of one and the same group); only links come out.

Pairs inside one group are skipped because their link can't change the
result; a pair between two groups is only skipped if its sets can't link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, materialize
from .components import components
from .textops import U64, mix, shingle_sets

CHUNKS, WIDTH = 10, 6
SYMBOLS = CHUNKS * WIDTH
#: Candidates farther apart are dropped: at similarity 0.85 a pair differs in
#: more than 24 of 60 symbols with a chance under 1e-6.
MAX_DISTANCE = 24
STAR_ROUNDS = 2
BLOCK = 256
#: Shingles a block may hold on average; long texts make smaller blocks.
BLOCK_SHINGLES = 1 << 18
#: Bytes of texts or sets sent to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Up to so many ids (or classes) are broadcast, more are joined.
SENT_IDS = 500_000

_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(0, 2**63, SYMBOLS, dtype=U64) * U64(2) + U64(1)
_FLIP = _rng.integers(0, 2**63, SYMBOLS, dtype=U64)
_PLACE = mix(_rng.integers(0, 2**63, SYMBOLS, dtype=U64))
_SLOT = mix(_rng.integers(0, 2**63, SYMBOLS, dtype=U64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of a non-empty array of shingle hashes."""
    low = np.full(SYMBOLS, np.iinfo(U64).max, dtype=U64)
    for lo in range(0, len(shingles), 8192):
        part = (shingles[lo:lo + 8192, None] ^ _FLIP) * _MULT
        np.minimum(low, part.min(axis=0), out=low)
    return (mix(low) >> U64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) bucket keys: key s covers the chunk of symbol s without s."""
    value = mix(signatures.astype(U64) * U64(0x9E3779B97F4A7C15) + _PLACE)
    chunks = value.reshape(len(value), CHUNKS, WIDTH)
    rest = (chunks.sum(axis=2, dtype=U64)[:, :, None] - chunks).reshape(len(value), SYMBOLS)
    return mix(rest + _SLOT).view(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column without nulls, as (rows, SYMBOLS)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signs = [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(signs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_key", "sig"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            keys = chunk_keys(_matrix(part.column("sig")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int8), len(keys))),
                 pa.array(np.repeat(part.column("rep").to_numpy(), SYMBOLS))], names=["key", "slot", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signature distance to rows (a, b, sig_a, sig_b)."""
    for batch in batches:
        d = distances(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(d.astype(np.int32))], names=["a", "b", "d"])


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())


def _linked(s: np.ndarray, t: np.ndarray) -> bool:
    both = _common(s, t)
    return 100 * both >= 85 * (len(s) + len(t) - both)


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Links between members of a block pair that lie in different groups.

    Candidates lie within MAX_DISTANCE; the nearest are confirmed first, and
    what a found link joins needs no second link.
    """
    table = table.sort_by("side")
    rep, comp, n, side = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
    raw = table.column("sig").to_pylist()
    sig = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, SYMBOLS)
    sets = [np.frombuffer(v, U64) for v in table.column("shingles").to_pylist()]
    split = int((side == 0).sum())
    same = split == len(rep)                       # a block against itself
    left, right = np.arange(split), np.arange(0 if same else split, len(rep))
    group = {int(c): int(c) for c in np.unique(comp)}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    found: list[tuple[int, int]] = []
    for lo in range(0, len(left), 64):
        i = left[lo:lo + 64]
        small, large = np.minimum(n[i][:, None], n[right][None]), np.maximum(n[i][:, None], n[right][None])
        ok = (comp[i][:, None] != comp[right][None]) & (100 * small >= 85 * large)
        if same:
            ok &= i[:, None] < right[None]
        p, q = np.nonzero(ok)
        p, q = i[p], right[q]
        far = distances(sig[p], sig[q])
        near = np.flatnonzero(far <= MAX_DISTANCE)
        for k in near[np.argsort(far[near], kind="stable")]:
            x, y = int(p[k]), int(q[k])
            cx, cy = root(int(comp[x])), root(int(comp[y]))
            if cx != cy and _linked(sets[x], sets[y]):
                group[max(cx, cy)] = min(cx, cy)
                found.append((int(rep[x]), int(rep[y])))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": ends.min(axis=1, initial=2**63 - 1), "b": ends.max(axis=1, initial=-2**63)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of a set: (rep, comp, n, key), n the set's size."""
    for batch in batches:
        sets = batch.column("shingles").to_pylist()
        n = np.array([len(v) // 8 for v in sets], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("rep").to_numpy(), n)), pa.array(np.repeat(batch.column("comp").to_numpy(), n)),
             pa.array(np.repeat(n, n)), pa.array(np.frombuffer(b"".join(sets), np.int64))], names=["rep", "comp", "n", "key"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose full sets have 100 * intersection >= 85 * union."""
    for batch in batches:
        keep = [_linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64))
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles): the full sets of the classes in ``wanted``, stored.

    A class is read from the text that stands for it, found by doc_id and text
    hash (an id alone may carry several texts).  Up to SENT_IDS classes go to
    the texts; more meet them in a join.
    """
    ids = materialize(wanted.join(reps, "rep").select("rep", F.col("low.doc_id").alias("doc_id"),
                                                      F.col("low.text_hash").alias("text_hash")), "ids")
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = docs.join(ids, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"])
    return materialize(texts.mapInArrow(_sets, "rep long, shingles binary"), "sets")


def confirm_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full shingle sets reach the threshold."""
    return _confirmed(pairs, full_sets(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long"))


def _grouped(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the group (comp) that the links so far give each rep."""
    if links is None:
        return members.withColumn("comp", F.col("rep"))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return (members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("comp", F.coalesce("component", "rep")).drop("component"))


def _sizes_allow(a: str, b: str):
    return 100 * F.least(a, b) >= 85 * F.greatest(a, b)


def _nearest(stars: DataFrame, sig: DataFrame) -> DataFrame:
    """The nearest by signature of each member's hubs: (a, b) of the rows (a, b)."""
    return (stars.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
            .where(_sizes_allow("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
            .mapInArrow(_near, "a long, b long, d int").where(F.col("d") <= MAX_DISTANCE)
            .groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", "best.b"))


def _prefixes(sets: DataFrame, apart: DataFrame) -> DataFrame:
    """(key, rep, comp, slack, rest): buckets by shingles that lose no link
    between two groups of ``apart`` (rep, comp).

    A set of n shingles linked with another shares at least 85 % of n with it,
    all of them found in two groups or more.  In one order of all shingles
    (rarest first) the first shingle shared is thus followed by the others,
    so it comes early; a set with too few shingles of two groups has no link.
    ``rest`` counts a set's shingles of two groups from this one on, ``slack``
    is n less that: what the set can't share with a set first met here.
    """
    each = materialize(sets.join(apart, "rep").select("rep", "comp", "shingles")
                       .mapInArrow(_listed, "rep long, comp long, n long, key long"), "listed")
    shared = (each.groupBy("key").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
              .where("lo <> hi").select("key", "df"))
    order = (each.join(shared, "key").groupBy("rep", "comp", "n")
             .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared")))
    spare = F.expr("cast(size(shared) - (85 * n + 99) div 100 as int)")          # shared shingles a link may lack
    order = order.withColumn("spare", spare).where("spare >= 0")
    return (order.select("rep", "comp", "n", F.size("shared").cast("long").alias("size"),
                         F.posexplode(F.slice("shared", F.lit(1), F.col("spare") + 1)).alias("at", "shingle"))
            .select(F.col("shingle.key").alias("key"), "rep", "comp",
                    (F.col("n") - F.col("size") + F.col("at")).alias("slack"), (F.col("size") - F.col("at")).alias("rest")))


def _may_link(slack_a: str, rest_a: str, slack_b: str, rest_b: str):
    """Whether two sets first met in a bucket can reach 85 %: they share m = the
    lesser rest at most, and their union holds m and what either lacks."""
    return 17 * (F.col(slack_a) + F.col(slack_b)) <= 3 * F.least(rest_a, rest_b)


def _least_lacking(rows: DataFrame) -> DataFrame:
    """Each member of a mixed bucket of ``_prefixes`` with the bucket's hub, the
    member of least slack, where they may link: (a, b)."""
    hub = (rows.groupBy("key").agg(F.min(F.struct("slack", "rep", "comp", "rest")).alias("hub"),
                                   F.min("comp").alias("lo"), F.max("comp").alias("hi"))
           .where("lo <> hi").select("key", "hub.*").toDF("key", "slack_b", "b", "comp_b", "rest_b"))
    return (rows.join(hub, "key").where("comp <> comp_b").where(_may_link("slack", "rest", "slack_b", "rest_b"))
            .select(F.col("rep").alias("a"), "b").distinct())


def _open(rows: DataFrame) -> DataFrame:
    """(key, rep, comp): members of buckets of ``_prefixes`` that may link with
    another group there, by the least that a member of one lacks."""
    by_comp = rows.groupBy("key", "comp").agg(F.min("slack").alias("least"))
    first = by_comp.groupBy("key").agg(F.min(F.struct("least", "comp")).alias("first")).select(
        "key", F.col("first.least").alias("first"), F.col("first.comp").alias("whose"))
    others = (by_comp.join(first, "key").where("comp <> whose").groupBy("key", "first", "whose")
              .agg(F.min("least").alias("second")))
    other = F.when(F.col("comp") == F.col("whose"), F.col("second")).otherwise(F.col("first"))
    return rows.join(others, "key").where(17 * (F.col("slack") + other) <= 3 * F.col("rest")).select("key", "rep", "comp")


def _exhaust(grouped: DataFrame, sets: DataFrame, sig: DataFrame) -> DataFrame:
    """All links between different groups that share a bucket.

    Every member of a bucket with two groups or more goes to a block of about
    BLOCK members (fewer long ones) that share the smallest member of their largest such bucket,
    that bucket's main group apart from the others; blocks that meet in a
    bucket are compared, unless both hold nothing but one and the same group.
    """
    by_comp = grouped.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("rep").alias("low"))
    apart = (by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.min("low").alias("hub"), F.count("*").alias("comps"))
             .where("comps > 1").select("key", F.col("top.comp").alias("main"), F.col("top.n").alias("most"), "hub"))
    open_rows = materialize(grouped.join(apart, "key"), "open")
    home = (open_rows.groupBy("rep", "comp").agg(F.max(F.struct("most", -F.col("hub"), "main")).alias("home"))
            .select("rep", "comp", (-F.col("home.col2")).alias("hub"), (F.col("comp") == F.col("home.main")).alias("is_main")))
    count = (home.join(sig.select("rep", "n"), "rep").groupBy("hub", "is_main")
             .agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")))
    home = materialize(home.join(count, ["hub", "is_main"]).join(sig, "rep").select(
        "rep", "comp", "n", "sig", F.xxhash64("hub", "is_main", F.pmod(F.xxhash64("rep"), "blocks")).alias("block")), "home")
    # the blocks that meet in a bucket; many buckets hold the same blocks
    lists = (open_rows.select("key", "rep").join(home.select("rep", "block"), "rep")
             .groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct())
    pairs = (lists.select("blocks", F.posexplode("blocks").alias("at", "block"))
             .select("block", F.explode(F.slice("blocks", F.col("at") + 1, F.size("blocks"))).alias("block_b")).distinct())
    span = home.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    pairs = (pairs.join(span, "block").join(span.toDF("block_b", "lo_b", "hi_b"), "block_b")
             .where("lo <> lo_b or hi <> hi_b or lo <> hi")
             .select("block", "block_b", F.xxhash64("block", "block_b").alias("pair")))
    sides = pairs.select("pair", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), "block"),
        F.struct(F.lit(1).alias("side"), F.col("block_b").alias("block")))).alias("s"), (F.col("block") == F.col("block_b")).alias("same"))
    sides = sides.where("s.side = 0 or not same").select("pair", "s.side", "s.block")
    rows = sides.join(home.join(sets, "rep"), "block").select("pair", "side", "rep", "comp", "n", "sig", "shingles")
    return rows.groupBy("pair").applyInArrow(_compare_blocks, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Duplicate groups of ``docs`` (doc_id, text, any other columns).

    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links, itself included), kept (doc_id is
    component_id).  A null, empty or wordless text has n_shingles 0 and is
    linked with nothing.  Equal sets form one class from the start, and only
    the row of its smallest doc_id takes part in the search.  Links are
    between texts: rows with one doc_id and one text come out alike, different
    texts under one doc_id are documents of their own, each with the component
    of its text.  A null doc_id takes part in its class alone and has a null
    component_id only if the class has no other id.  An empty table gives an
    empty result.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = materialize(docs.mapInArrow(
        _sign, "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary"), "signed")
    classes = (signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
               .agg(F.min(F.struct("doc_id", "text_hash")).alias("low"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")))
    # classes are numbered, since one doc_id may stand for several of them
    reps = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "reps")
    postings = reps.select("rep", "sig").mapInArrow(_post, "key long, slot byte, rep long")
    shared = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(postings.join(shared, "key").select("key", "slot", "rep"), "postings")
    sig = reps.select("rep", "n", "sig")

    links = None
    for turn in range(STAR_ROUNDS):
        grouped = _grouped(members, links)
        order = F.struct(F.xxhash64("rep", F.lit(turn)) if turn else F.lit(0).cast("long"), "rep", "comp")
        apart = (grouped.groupBy("key").agg(F.min(order).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo <> hi").select("key", "hub.rep", "hub.comp").toDF("key", "b", "comp_b"))
        stars = grouped.join(apart, "key").where("comp <> comp_b").select(F.col("rep").alias("a"), "b").distinct()
        found = confirm_links(docs, reps, materialize(_nearest(stars, sig), "near"))
        links = materialize(found if links is None else links.unionByName(found), "links")

    grouped = materialize(_grouped(members, links), "grouped")
    mixed = grouped.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = materialize(grouped.join(mixed, "key").select("rep", "comp").distinct(), "apart")
    sets = full_sets(docs, reps, apart.select("rep"))
    alike = materialize(_prefixes(sets, apart), "alike")
    found = _confirmed(materialize(_nearest(_least_lacking(alike), sig), "near"), sets)
    links = materialize(links.unionByName(found), "links")
    alike = materialize(_grouped(alike.drop("comp"), links), "alike")
    links = materialize(links.unionByName(_exhaust(_open(alike), sets, sig)), "links")

    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = reps.select("set_key", "rep", F.col("low.doc_id").alias("doc_id"))
    found = materialize(named.select("rep", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep"), "found")
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    least = F.broadcast(least) if least.count() <= SENT_IDS else least
    labels = (named.join(found.join(least, "component").select("rep", "least"), "rep", "left")
              .select("set_key", F.coalesce("least", "doc_id").alias("label")))
    return (signed.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
