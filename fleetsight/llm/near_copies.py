"""Near copies by sets of word shingles: SimHash and MinHash find pairs, their exact Jaccard likeness decides.

Texts with the same set are one class. A class has the SimHash fingerprint of its set; ``simhash.links``, the Gray-order
index of op9, finds the fingerprints at ``NEAR`` or fewer differing bits, and star contraction makes groups of them. The
classes of a group are a bucket. Sets of likeness 0.8 differ in some ten bits of 64 as a rule, more than any index by
equal bits can carry, so buckets of MinHash bands stand beside the groups for what these miss. ``BANDS`` bands of
``ROWS`` minima put a class into as many buckets; two sets of likeness 0.8 share none with a chance of 4 in 10,000, likelier ones with less. Pairs of a bucket
are held against each other by their whole sets, of which only the texts in pairs are read again.

In a bucket of more than ``SMALL`` classes each is first paired with the smallest, the largest and two more that
differ from band to band, so that pairs of a large group of copies grow with its members and not with their
square. Where that leaves a large bucket in several components, its classes are searched by rare shingles:
of two sets that are alike the smaller has a common shingle among its rarest n - ceil(2 s / (1 + s) n) + 1 and
the larger among its rarest n - ceil(s n) + 1, with the likeness s. This takes two steps. In the first, classes
of different components meet all with all in a shingle that up to ``SMALL`` sets have, and each with two in a more
frequent one. In the second, what is still in different components meets in every rare shingle, unless the
places of the shingle in both sets leave too few shingles behind it for the likeness. So no link of a large
bucket is lost: pages of one template, which share frequent shingles, are held against each other only where
they can be alike beyond it.

Defined results: words are split at ASCII white space and compared with ASCII letters in lower case; a text of
fewer words than a shingle is one shingle; null and blank texts have the empty set and are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.flat import Flat, chunks, mix, whole_windows, window_hashes, window_hashes_at
from fleetsight.llm.simhash import FILTER_BLOCKS, least_ids, links, set_fingerprints, star_roots
from fleetsight.llm.url_filter import may_be_listed
from fleetsight.session import checkpointed

SHINGLE = 5
LIKENESS = 0.8
NEAR = 3
BANDS = 20
ROWS = 5
SMALL = 32
BLOCK = 256

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_rng = np.random.Generator(np.random.PCG64(20240311))
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the distinct shingles of text k, in order, are ``hashes[cuts[k] : cuts[k + 1]]``."""
    flat = Flat([text.translate(_LOWER) for text in texts])
    starts, ends = flat.words()
    first, words = flat.first_of(starts), flat.hashes(starts, ends)
    found = window_hashes(words, size)
    at = np.flatnonzero(whole_windows(first, found.size, size))
    keys, owners = [found[at]], [np.searchsorted(first, at, side="right") - 1]
    for few in range(1, size):
        short = np.flatnonzero(np.diff(first) == few)
        keys.append(window_hashes_at(words, first[short], few))
        owners.append(short)
    hashes, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(hashes.size, dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def band_values(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` values for each set that is not empty."""
    starts = cuts[:-1][np.diff(cuts) > 0]
    out = np.zeros((starts.size, BANDS), dtype=np.uint64)
    if starts.size:
        for k in range(BANDS * ROWS):
            out[:, k // ROWS] = mix(out[:, k // ROWS] + np.minimum.reduceat((hashes ^ _FLIP[k]) * _ODD[k], starts))
    return out


def _marks(size: int):
    """The class of each text, by its set, with the set's fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                hashes, cuts = shingle_sets(texts, size)
                names = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() for a, b in zip(cuts[:-1], cuts[1:])]
                ends = np.concatenate([[0], np.cumsum(np.diff(cuts) > 0)]) * BANDS
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_values(hashes, cuts).reshape(-1).view(np.int64)))
                kept = [batch.column(name).slice(start, len(texts)) for name in ("doc_id", "mark")]
                names = pa.array(np.frombuffer(b"".join(names), "<i8"))
                codes = pa.array(set_fingerprints(hashes, cuts).view(np.int64))
                yield pa.RecordBatch.from_arrays([*kept, names, codes, bands], ["doc_id", "mark", "bits", "code", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                hashes, cuts = shingle_sets(texts, size)
                bodies = pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("bits").slice(start, len(texts)), bodies], ["bits", "body"])

    return run


def _alike(likeness: float):
    """The pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (one, other) in enumerate(zip(batch.column("one"), batch.column("other"))):
                one, other = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(other.as_buffer(), "<u8")
                if min(one.size, other.size) >= likeness * max(one.size, other.size) - 1:
                    both = np.intersect1d(one, other, assume_unique=True).size
                    keep[k] = both / (one.size + other.size - both) >= likeness
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def bucket_pairs(classes: DataFrame) -> DataFrame:
    """``a, b`` (a < b): all pairs of a bucket of up to ``SMALL`` classes, each class with four others of a larger one."""
    spread = classes.select("bits", F.posexplode("bands").alias("band", "value"))
    dealt = F.xxhash64("bits", "band")
    stars = [F.min("bits"), F.max("bits"), F.min_by("bits", dealt), F.max_by("bits", dealt)]
    buckets = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), *[star.alias(f"s{k}") for k, star in enumerate(stars)])
    buckets = checkpointed(buckets.filter("n > 1"))
    small = spread.join(buckets.filter(F.col("n") <= SMALL).select("band", "value"), ["band", "value"], "left_semi")
    small = small.groupBy("band", "value").agg(F.collect_list("bits").alias("members"))
    small = small.select("members", F.explode("members").alias("bits")).select("bits", F.explode("members").alias("star"))
    large = spread.join(buckets.filter(F.col("n") > SMALL), ["band", "value"])
    large = large.select("bits", F.explode(F.array("s0", "s1", "s2", "s3")).alias("star"))
    paired = small.unionByName(large).filter("bits <> star")
    return paired.select(F.least("bits", "star").alias("a"), F.greatest("bits", "star").alias("b")).distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets as one row per shingle."""
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(body) >> 3 for body in bodies], dtype=np.int64)
        bits, part = (np.repeat(batch.column(name).to_numpy(), sizes) for name in ("bits", "part"))
        columns = [bits, part, np.repeat(sizes, sizes), np.frombuffer(b"".join(bodies), "<i8")]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["bits", "part", "n", "shingle"])


def rare_shingles(sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``shingle, bits, part, n, at, early``: the shingles by which ``sets`` (``bits, part, body``) of several parts can meet.

    ``at`` is a shingle's place in its set, rarest first; ``early`` are the places by which the smaller set of a pair meets.
    """
    shingles = sets.select("bits", "part", "body").mapInArrow(_shingles, "bits long, part long, n long, shingle long")
    shingles = checkpointed(shingles)
    stat = shingles.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("found"), (F.min("part") != F.max("part")).alias("mixed")
    )
    order = Window.partitionBy("bits").orderBy("found", "shingle")
    placed = shingles.join(stat, "shingle").withColumn("at", F.row_number().over(order)).filter("mixed")
    rarest = lambda share: F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    early = rarest(2 * likeness / (1 + likeness)).alias("early")
    return checkpointed(placed.filter(rarest(likeness)).select("shingle", "bits", "part", "n", "at", early))


def first_pairs(rare: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``a, b`` (a < b): pairs of different parts, in proportion to the members of a shingle.

    All pairs that share a shingle of up to ``SMALL`` sets among their rarest; of a more frequent one each set with two.
    """
    member = F.struct("bits", "part", "n")
    # The same few classes stand for all shingles of a group, so that its pairs stay in proportion to its members.
    chosen = [F.min_by(member, F.xxhash64("bits")).alias("s0"), F.max_by(member, F.xxhash64("bits")).alias("s1")]
    buckets = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), *chosen)
    sized = rare.join(buckets, "shingle")
    one = member.alias("x")
    large = sized.filter(F.col("members") > SMALL).select(one, F.explode(F.array("s0", "s1")).alias("y"))
    few = sized.filter(F.col("members") <= SMALL).select("shingle", "early", one)
    small = few.filter("early").select("shingle", "x").join(few.select("shingle", F.col("x").alias("y")), "shingle").select("x", "y")
    met = small.unionByName(large).filter("x.part <> y.part")
    met = met.filter(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * likeness - 1e-9)
    return met.select(F.least("x.bits", "y.bits").alias("a"), F.greatest("x.bits", "y.bits").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``first_pairs`` of ``sets`` (``bits, part, body``)."""
    return first_pairs(rare_shingles(sets, likeness), likeness)


def remaining_pairs(rare: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``a, b`` (a < b): every pair of different parts that can be alike.

    The first common shingle of two sets at places i and k has at most min(n - i, m - k) further ones behind it,
    and two sets that are alike share at least s / (1 + s) (n + m). Shingles of many sets are dealt as a grid of
    blocks, so that no key holds more than ``2 * BLOCK`` rows on average.
    """
    held = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), (F.min("part") != F.max("part")).alias("mixed"))
    held = held.filter("mixed").select("shingle", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    sized = rare.join(held, "shingle").withColumn("own", F.pmod(F.xxhash64("bits", "shingle"), F.col("blocks")).cast("int"))
    member = F.struct("bits", "part", "n", "at")
    across = F.explode(F.expr("sequence(0, blocks - 1)"))
    one = sized.filter("early").select("shingle", F.col("own").alias("i"), across.alias("k"), member.alias("x"))
    other = sized.select("shingle", across.alias("i"), F.col("own").alias("k"), member.alias("y"))
    smaller = F.expr("x.part <> y.part AND (x.n < y.n OR (x.n = y.n AND x.bits < y.bits))")
    enough = (F.col("x.n") + F.col("y.n")) * (likeness / (1 + likeness)) - 1e-9
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    sizes = F.col("x.n") >= F.col("y.n") * likeness - 1e-9
    met = one.join(other, ["shingle", "i", "k"]).filter(smaller & sizes & (behind >= enough))
    return met.select(F.least("x.bits", "y.bits").alias("a"), F.greatest("x.bits", "y.bits").alias("b")).distinct()


def _links(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs whose sets are alike."""
    both = pairs.join(sets.select(F.col("bits").alias("a"), F.col("body").alias("one")), "a")
    both = both.join(sets.select(F.col("bits").alias("b"), F.col("body").alias("other")), "b")
    return both.select("a", "b", "one", "other").mapInArrow(_alike(likeness), "a long, b long")


def _unsettled(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``bits, part``: classes of the large buckets that lie in more than one component, with theirs."""
    spread = classes.select("bits", F.posexplode("bands").alias("band", "value"))
    sizes = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
    members = spread.join(sizes.filter(F.col("n") > SMALL), ["band", "value"])
    members = members.join(roots, F.col("bits") == F.col("node"), "left").select("band", "value", "bits", F.coalesce("root", "bits").alias("part"))
    members = checkpointed(members)
    mixed = members.groupBy("band", "value").agg((F.min("part") != F.max("part")).alias("mixed")).filter("mixed")
    return members.join(mixed, ["band", "value"], "left_semi").select("bits", "part").distinct()


def _marked(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text, mark`` of every row; ``doc_id, mark, bits, code, bands``); the mark is a hash of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return rows, checkpointed(rows.mapInArrow(_marks(shingle), "doc_id long, mark long, bits long, code long, bands array<long>"))


def _joined(roots: DataFrame, further: DataFrame) -> DataFrame:
    """``roots`` with the components that ``further`` links."""
    if further.isEmpty():
        return roots
    return star_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further))


def with_groups(classes: DataFrame, distance: int = NEAR) -> DataFrame:
    """``classes`` with one more band: the group of their fingerprint ``code`` by links of ``distance`` or fewer bits."""
    codes = checkpointed(classes.select(F.col("code").alias("bits")).distinct())
    grouped = classes.join(star_roots(links(codes, distance, trees=True)), F.col("code") == F.col("node"), "left")
    group = F.array(F.coalesce("root", "code"))
    return grouped.select(*[name for name in classes.columns if name != "bands"], F.concat("bands", group).alias("bands"))


def _rooted(rows: DataFrame, marked: DataFrame, shingle: int, likeness: float) -> tuple[DataFrame, DataFrame]:
    """(classes with a mark of one of their texts and their smallest row; ``node, root`` of linked classes)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    # Equal sets have equal fingerprints and bands; the mark finds one of the class's texts again.
    same = [F.first(name).alias(name) for name in ("code", "bands")]
    classes = checkpointed(marked.groupBy("bits").agg(first, F.min("mark").alias("mark"), *same))
    classes = checkpointed(with_groups(classes))
    pairs = checkpointed(bucket_pairs(classes))
    paired = pairs.select(F.col("a").alias("bits")).unionByName(pairs.select(F.col("b").alias("bits"))).distinct()
    wanted = checkpointed(classes.join(paired, "bits", "left_semi").select("bits", F.col("mark").alias("wanted")))
    probed = may_be_listed(rows.select("mark", "text"), "mark", wanted, "wanted", FILTER_BLOCKS).filter("possible")
    once = probed.groupBy("mark").agg(F.first("text").alias("text"))
    sets = checkpointed(once.join(wanted, F.col("mark") == F.col("wanted")).select("bits", "text").mapInArrow(_sets(shingle), "bits long, body binary"))
    edges = checkpointed(_links(pairs, sets, likeness))
    roots = star_roots(edges)
    open_ones = checkpointed(_unsettled(classes, roots))
    if not open_ones.isEmpty():
        rare = rare_shingles(sets.join(open_ones, "bits"), likeness)
        roots = _joined(roots, checkpointed(_links(first_pairs(rare, likeness), sets, likeness)))
        parted = rare.drop("part").join(roots, F.col("bits") == F.col("node"), "left")
        parted = checkpointed(parted.select("shingle", "bits", F.coalesce("root", "bits").alias("part"), "n", "at", "early"))
        roots = _joined(roots, checkpointed(_links(remaining_pairs(parted, likeness), sets, likeness)))
    return classes, roots


def components(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """``doc_id, component_id``: one row per input row.

    ``component_id`` is the smallest id that pairs of at least ``likeness`` reach, the own id included; a
    null id is never the smallest.
    """
    rows, marked = _marked(docs, shingle)
    classes, roots = _rooted(rows, marked, shingle, likeness)
    least = least_ids(classes.select("bits", F.col("first.doc_id").alias("least_id")), roots)
    return marked.select("doc_id", "bits").join(least, "bits").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """The rows of ``docs`` that come first in their component: by id, then by a hash of the text.

    A row is told by id and text, so two texts under one id are judged each for itself, and of rows equal in
    both one stays. Rows without an id stay. Columns are as they came, of any type.
    """
    rows, marked = _marked(docs, shingle)
    classes, roots = _rooted(rows, marked, shingle, likeness)
    rooted = classes.join(roots, classes.bits == roots.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    winners = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("winner")), "root").select("bits", "winner")
    judged = marked.filter("doc_id IS NOT NULL").join(winners, "bits").groupBy("doc_id", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.first((F.col("winner.doc_id") == F.col("doc_id")) & (F.col("winner.mark") == F.col("mark"))).alias("stays")
    )
    # Only rows that go or repeat are written, the smaller side. A row that the Bloom filter of these lets
    # through stays without a shuffle of its text; the others are joined exactly.
    found = checkpointed(judged.filter("NOT coalesce(stays, FALSE) OR n > 1").select("doc_id", "mark", F.xxhash64("doc_id", "mark").alias("key"), F.coalesce("stays", F.lit(False)).alias("stays")))
    wrapped = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ).withColumn("key", F.when(F.col("id").isNotNull(), F.xxhash64("id", "mark")))
    probed = may_be_listed(wrapped, "key", found.select(F.col("key").alias("listed")), "listed", FILTER_BLOCKS)
    unsure = probed.filter("possible")
    gone = found.select(F.col("doc_id").alias("id"), "mark")
    kept = probed.filter("NOT possible").select("row.*").unionByName(unsure.join(gone, ["id", "mark"], "left_anti").select("row.*"))
    repeated = found.filter("stays").select(F.col("doc_id").alias("id"), "mark")
    if not repeated.isEmpty():
        again = unsure.join(repeated, ["id", "mark"], "left_semi").groupBy("id", "mark")
        kept = kept.unionByName(again.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return kept
