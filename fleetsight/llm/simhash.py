"""SimHash near-duplicates with a Gray-order hierarchical index.

Equal fingerprints count once. Two fingerprints at ``DISTANCE`` or fewer differing bits (or another distance that
a caller of ``links`` names) agree on at least one of ``DISTANCE + 1`` bit blocks, so every fingerprint goes into one
group per block; the shared block is the group's uppermost node. In a group fingerprints are sorted by Gray rank, which puts similar patterns
side by side; runs of ``FANOUT`` become nodes that hold the bits all members share, and a node keeps only
the bits that its parent does not hold yet. A search adds up differing bits from node to node and drops a
whole node once the sum passes the limit. A group of more than ``GROUP_LIMIT`` members is split by further
blocks of its free bits, three times at most; after that 2^20 different fingerprints are the bound.

Links join documents into components by repeated star contraction, each round written to the shared
checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.session import checkpointed

SHINGLE = 3
DISTANCE = 2
SEED = 42
FANOUT = 16
GROUP_LIMIT = 50_000
DEPTH = 3
# Blocks of the filter of ids that go: at most 23 MB to broadcast, useful up to some ten million such ids.
FILTER_BLOCKS = 1 << 18
# Rows of several groups that a task searches together, and searches that run side by side.
ROWS_AT_ONCE = 200_000
SEARCHES_AT_ONCE = 1 << 15

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the hashes of the shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, _SHINGLES_AT_ONCE):
        part = hashes[at : at + _SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view("<u8")[0])


def set_fingerprints(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The fingerprint of each set ``hashes[cuts[k] : cuts[k + 1]]`` of shingle hashes; zero for an empty one."""
    sizes = np.diff(cuts)
    held = np.flatnonzero(sizes)
    out = np.zeros(sizes.size, dtype=np.uint64)
    for bit in range(64 if held.size else 0):
        ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64), cuts[held])
        out[held] |= (ones * 2 > sizes[held]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bits``: the fingerprint as a signed long. A null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(value) for value in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, bits long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _finer(mask: int, distance: int) -> list[int]:
    """The mask with one of ``distance + 1`` equal parts of its free bits added, for each part."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    parts = distance + 1
    edges = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:])]


def _grouped(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Rows ``bits, mask`` once for every finer mask of theirs, with the group's value under that mask."""
    choice = F.lit(None).cast("array<long>")
    for mask in masks:
        choice = F.when(F.col("mask") == _signed(mask), F.array(*[F.lit(_signed(m)) for m in _finer(mask, distance)])).otherwise(choice)
    return rows.select("bits", F.explode(choice).alias("mask")).withColumn("value", F.col("bits").bitwiseAND(F.col("mask")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the Gray sequence: each bit is the parity of the bits from the top down to it."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Gray-order tree over fingerprints that come sorted by (group, Gray rank)."""

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.codes = codes
        all_bits = np.uint64(0xFFFFFFFFFFFFFFFF)
        # From the leaves up: (first child, end of children, bits all members share, their values, group).
        self.levels: list[list[np.ndarray]] = []
        ones, zeros, owner = codes, ~codes, group
        while True:
            new = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
            if self.levels and new.size == owner.size:
                break
            sizes = np.diff(np.append(new, owner.size))
            within = np.arange(owner.size) - np.repeat(new, sizes)
            first = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            owner = owner[first]
            self.levels.append([first, np.append(first[1:], within.size), ones | zeros, ones, owner])
        self.own = []  # bits a node holds and its parent does not
        for (low, high) in zip(self.levels, self.levels[1:]):
            above = np.repeat(high[2], high[1] - high[0])
            self.own.append(low[2] & ~above)
        self.own.append(self.levels[-1][2])
        self.item_own = all_bits & ~np.repeat(self.levels[0][2], self.levels[0][1] - self.levels[0][0])
        ends = codes.size * np.ones(1, dtype=np.int64)
        self.last = []  # end of the items below each node
        for level in self.levels:
            ends = level[1] if not self.last else self.last[-1][level[1] - 1]
            self.last.append(ends)
        roots = self.levels[-1][4]
        self.root_of = np.searchsorted(roots, group)

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (a < b) in one group at ``distance`` or fewer bits."""
        for at in range(0, self.codes.size, SEARCHES_AT_ONCE):
            who = np.arange(at, min(at + SEARCHES_AT_ONCE, self.codes.size))
            node, spent = self.root_of[who], np.zeros(who.size, dtype=np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                first, end, _, values, _ = self.levels[depth]
                spent = spent + np.bitwise_count((self.codes[who] ^ values[node]) & self.own[depth][node])
                keep = (spent <= distance) & (self.last[depth][node] > who + 1)
                who, node, spent = who[keep], node[keep], spent[keep]
                sizes = end[node] - first[node]
                offset = np.cumsum(sizes) - sizes
                below = np.arange(int(sizes.sum())) + np.repeat(first[node] - offset, sizes)
                who, spent, node = np.repeat(who, sizes), np.repeat(spent, sizes), below
            spent = spent + np.bitwise_count((self.codes[who] ^ self.codes[node]) & self.item_own[node])
            keep = (spent <= distance) & (node > who)
            yield who[keep], node[keep]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``count`` places those that the pairs join with a smaller one, and the smallest place of their component."""
    least = np.arange(count)
    for a, b in pairs:
        while a.size:
            low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
            apart = low < high
            a, b = a[apart], b[apart]
            np.minimum.at(least, high[apart], low[apart])
            while (least[least] < least).any():
                least = least[least]
    joined = np.flatnonzero(least < np.arange(count))
    return joined, least[joined]


def _search(distance: int, trees: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (mask, value): index and search several whole groups at a time."""

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1] < 2:
                return
            _, group = np.unique(rows[:2], axis=1, return_inverse=True)
            group = group.reshape(-1)
            codes = rows[2].view(np.uint64)
            order = np.lexsort((gray_rank(codes), group))
            codes, group = codes[order], group[order]
            alone = np.bincount(group)[group] < 2
            codes, group = codes[~alone], group[~alone]
            if codes.size:
                pairs = Index(codes, group).links(distance)
                for a, b in [forest(pairs, codes.size)] if trees else pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], ["a", "b"]
                    )

        held = np.zeros((3, 0), dtype=np.int64)
        for batch in batches:
            rows = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("mask", "value", "bits")])
            held = np.concatenate([held, rows], axis=1)
            if held.shape[1] >= ROWS_AT_ONCE:
                same = (held[0] == held[0, -1]) & (held[1] == held[1, -1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                yield from found(held[:, :cut])
                held = held[:, cut:]
        yield from found(held)

    return run


def links(codes: DataFrame, distance: int = DISTANCE, trees: bool = False) -> DataFrame:
    """``a, b``: different fingerprints of ``codes`` (distinct ``bits``) at ``distance`` or fewer bits.

    A pair that agrees on several blocks is found in each of them. With ``trees`` a group gives, for the pairs found
    in it, one edge from each fingerprint to the first of its component: the same components by no more edges than rows.
    """
    level = _grouped(codes.select("bits", F.lit(0).cast("long").alias("mask")), [0], distance)
    masks = _finer(0, distance)
    ready = None
    for depth in range(DEPTH):
        hot = None
        if depth < DEPTH - 1:
            hot = checkpointed(level.groupBy("mask", "value").count().filter(F.col("count") > GROUP_LIMIT).drop("count"))
            if hot.isEmpty():
                hot = None
        cold = level if hot is None else level.join(hot, ["mask", "value"], "left_anti")
        ready = cold if ready is None else ready.unionByName(cold)
        if hot is None:
            break
        # Two masks may be refined to the same one; a fingerprint is in a group once.
        level = _grouped(level.join(hot, ["mask", "value"], "left_semi").select("bits", "mask"), masks, distance).distinct()
        masks = [finer for mask in masks for finer in _finer(mask, distance)]
    dealt = ready.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.select("mask", "value", "bits").mapInArrow(_search(distance, trees), "a long, b long")


def star_roots(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of an edge its component's smallest node, the root itself left out.

    Alternates the two star steps (large: neighbours above a node move to its minimum; small: those
    below it do) until the edges stay as they are, which takes about log(n) rounds.
    """

    def summary(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.filter("a <> b").distinct())
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").filter("a <> b").distinct())
        after = summary(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_ids(codes: DataFrame, roots: DataFrame) -> DataFrame:
    """``bits, component_id`` of ``codes`` (``bits, least_id``): the smallest id of each component."""
    rooted = codes.join(roots, codes.bits == roots.node, "left").select(
        "bits", "least_id", F.coalesce("root", "bits").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("bits", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id that links of
    ``DISTANCE`` or fewer differing bits reach, the own id included. Repeated rows come out repeated; a
    null id is never the smallest.
    """
    marked = checkpointed(fingerprints(docs, doc_id, text))
    codes = checkpointed(marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")))
    of_code = least_ids(codes, star_roots(links(codes.select("bits"))))
    return marked.join(of_code, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )
