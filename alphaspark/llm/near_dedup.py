"""Near-duplicate documents: min-max hashing, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHasher, chunks, mix, signed, staged
from .components import connected_components

#: Both ends of 64 permutations: 128 values, 32 bands of 4.  A pair at similarity 0.8 shares no band
#: with probability (1 - 0.8**4)**32 = 5e-8.
PERMUTATIONS, BAND_ROWS = 64, 4
#: Unlinked members, and members they are held against, that one call compares; and members of the pivot's component that
#: more than a block of unlinked ones are held against before.
BLOCK, CHUNK, PROBES = 256, 512, 64
_STEP = 2048


def shingle_set(words: list[bytes], width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of fewer words, the whole as one."""
    h = hasher.of(words)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    take = min(width, len(h))
    out = np.full(n, U64(take))
    for j in range(take):
        out = out * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(mix(out))


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: two values for one evaluation."""
    low, high = np.full(len(a), np.iinfo(U64).max, U64), np.zeros(len(a), U64)
    for at in range(0, len(hashes), _STEP):
        p = a[:, None] * hashes[None, at : at + _STEP] + b[:, None]
        np.minimum(low, p.min(axis=1), out=low)
        np.maximum(high, p.max(axis=1), out=high)
    return np.concatenate([low, high])


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.int64).view(U64) * U64(2) + U64(1), r.integers(0, 1 << 63, n, dtype=np.int64).view(U64)


def _sketches(width: int, perms: int, band_rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (a, b) = WordHasher(), permutations(perms)
        bands = 2 * perms // band_rows
        # A band takes values of different permutations: band_rows minima or band_rows maxima.
        salt = mix(np.arange(1, bands + 1, dtype=U64))
        for part, (ids, texts) in chunks(batches):
            n, high, low, keys = [], [], [], []
            for text in texts:
                s = shingle_set((text or b"").lower().split(), width, hasher)
                n.append(len(s))
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                if len(s):
                    k = salt.copy()
                    for column in signature(s, a, b).reshape(bands, band_rows).T:
                        k = mix(k * U64(0x9E3779B97F4A7C15) + column)
                    keys.append(k.view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), arrays], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part, (_, texts) in chunks(batches):
            sets = [shingle_set((t or b"").lower().split(), width, hasher) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, U64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), signed(flat))], ["node", "shingles"])

    return run


def _compare(percent: int):
    """(left: unlinked members x, right: members y) of one group part -> links (a, b) between components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        xs, xc, xs_sets = left["x"].to_numpy(), left["component"].to_numpy(), left["shingles"].combine_chunks()
        ys, yc, ys_sets = right["y"].to_numpy(), right["component"].to_numpy(), right["shingles"].combine_chunks()
        a, b = [], []
        if len(xs) and len(ys):
            lengths = np.diff(xs_sets.offsets.to_numpy())
            keys, owners = xs_sets.flatten().to_numpy(), np.repeat(np.arange(len(xs)), lengths)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            for y, c, own in zip(ys, yc, ys_sets, strict=True):
                own = own.values.to_numpy()
                lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                count = hi - lo
                at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.bincount(owners[at], minlength=len(xs))
                near = np.flatnonzero((100 * both >= percent * (lengths + len(own) - both)) & (xc != c) & (xs != y))
                a += [y] * len(near)
                b += xs[near].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, perms: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z and split at ASCII white space; documents are linked where the sets of their
    ``width``-word shingles have 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.

    Documents of one set are a class, known by a 128-bit digest; its smallest doc_id stands for it, and copies take its
    component in the end.  Classes go into one bucket a band.  No bucket is expanded into pairs.  Its pivot, the member that
    shares most buckets with most others, is compared with every member on full sets, and links are joined into components.
    Two members that aren't connected by then include one outside their pivot's component; where these are many, they are
    first compared with a few of that component.  Those still outside are compared with all the pivot's other members in
    blocks, which give only the links.  So every pair that shares a band is compared or connected.

    Null or empty texts, and texts of white space: the empty set, n_shingles 0, linked with nothing.  Fewer words
    than ``width``: one shingle.  Rows that repeat a doc_id with the same text are classmates; a doc_id with several
    texts is one node, linked by each of them.  Null ids: kept alone, component_id null.  No rows: no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kinds = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"
    sketches = staged(texts.mapInArrow(_sketches(width, perms, band_rows), kinds), "sketches")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Staged, as the other counts below, so that joins stand on plain exchanges, whose hot keys Spark can split.
    classes = staged(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("node")), "classes")
    of_class = full.join(classes, ["c1", "c2"])
    # Only a doc_id with several texts ties classes together; other copies aren't in the graph.
    ids = of_class.select("doc_id", "node").distinct()
    several = staged(ids.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("doc_id", "lo"), "several")
    ties = ids.join(several, "doc_id").where("node != lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    placed = of_class.where("doc_id = node").select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    shared = staged(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("bucket", "size"), "shared")
    buckets = staged(placed.join(shared, "bucket"), "buckets")

    # One row for each pivot and member; the pivot is the heaviest member, and the smallest of equals.
    weights = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = buckets.join(weights, "node").select("bucket", "node", "n", "weight")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"), "n")).alias("p"))
    stars = staged(buckets.join(staged(pivots.select("bucket", (-F.col("p.less")).alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots"), "bucket").select("pivot", "pivot_n", "node", "n").where("pivot != node").distinct(), "stars")
    wanted = stars.select("node").union(stars.select("pivot")).distinct().withColumnRenamed("node", "__node")
    sets = staged(texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("__node"), "left_semi").mapInArrow(_sets(width), "node long, shingles array<long>"), "sets")
    pairs = stars.where(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)").select("pivot", "node").distinct()
    with_sets = pairs.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("sa")), "pivot").join(sets.withColumnRenamed("shingles", "sb"), "node")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = with_sets.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    links = staged(ties.union(linked.select(F.col("pivot").alias("a"), F.col("node").alias("b"))), "links")
    groups = connected_components(links)

    # Groups (pivot and members) with members in several components, of which some aren't in the pivot's.
    members = staged(_members(stars, groups), "members")
    large = staged(_open(members).where(F.col("outside") > BLOCK).withColumn("blocks", F.ceil(F.col("outside") / BLOCK).cast("long")), "large")
    if large.head(1):
        # Near copies of each other are mostly linked with some of a few that are in the component; the rest goes the long way.
        apart = members.join(large, F.col("pivot") == F.col("group"))
        by_hash = Window.partitionBy("group").orderBy(F.xxhash64("node"), "node")
        probes = apart.where("component = own").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= PROBES)
        found = _links(apart.where("component != own").withColumn("chunks", F.lit(1).cast("long")), probes.withColumn("chunks", F.lit(1).cast("long")), sets, percent, "probed")
        if found.head(1):
            groups = connected_components(_as_edges(groups).union(found))
            members = staged(_members(stars, groups), "members")
    # Each chunk of a group's members meets each block of those outside the pivot's component.
    sizes = members.groupBy(F.col("pivot").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    open_ = staged(_open(members).withColumn("blocks", F.ceil(F.col("outside") / BLOCK).cast("long")).join(sizes, F.col("group") == F.col("of")).drop("of"), "open")
    grouped = members.join(open_, F.col("pivot") == F.col("group"))
    more = _links(grouped.where("component != own"), grouped, sets, percent, "more")
    if more.head(1):
        groups = connected_components(_as_edges(groups).union(more))

    found = classes.join(groups.select(F.col("node").alias("__node"), "component"), F.col("node") == F.col("__node"), "left").select(F.col("c1").alias("__c1"), F.col("c2").alias("__c2"), F.coalesce("component", "node").alias("component"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (
        sketches.select("doc_id", "n_shingles", "c1", "c2").join(found, (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")), "left")
        .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _members(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """(pivot, node, component, own): the members of each pivot's buckets with their component and the pivot's."""
    known = groups.withColumnRenamed("node", "__n")
    own = stars.select("pivot", "node").distinct().join(known.withColumnRenamed("component", "c"), F.col("node") == F.col("__n"), "left").select("pivot", "node", F.coalesce("c", "node").alias("component"))
    return own.join(known.withColumnRenamed("component", "pc"), F.col("pivot") == F.col("__n"), "left").select("pivot", "node", "component", F.coalesce("pc", "pivot").alias("own"))


def _open(members: DataFrame) -> DataFrame:
    """(group, outside): groups in which two members may be linked that aren't connected, and how many are outside the pivot's component."""
    counted = members.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum((F.col("component") != F.col("own")).cast("long")).alias("outside"))
    return counted.where("lo != hi AND outside > 0").select(F.col("pivot").alias("group"), "outside")


def _as_edges(groups: DataFrame) -> DataFrame:
    return groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _links(outside: DataFrame, others: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(a, b): links between components of rows (group, blocks, chunks, node, component): each block of ``outside``
    is compared with each chunk of ``others`` in its group."""
    own = sets.withColumnRenamed("node", "__n")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = outside.join(own, F.col("node") == F.col("__n")).select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), each("chunks").alias("chunk"), F.col("node").alias("x"), "component", "shingles")
    right = others.join(own, F.col("node") == F.col("__n")).select("group", each("blocks").alias("block"), F.pmod(F.xxhash64(F.lit(3), "node"), F.col("chunks")).alias("chunk"), F.col("node").alias("y"), "component", "shingles")
    left, right = (df.select([F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # fresh names: both come from the same tables
    key = ["group", "block", "chunk"]
    return staged(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare(percent), "a long, b long").distinct(), name)
