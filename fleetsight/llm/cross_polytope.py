"""Nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
goes to the nearest of the signed axes. A hash joins one or more such axes, the last of them from a part of the
axes only, so that buckets hold ``BUCKET_ROWS`` rows on average whatever the size of the table; ``TABLES``
tables of independent rotations are kept. A query looks into the buckets of its likeliest axes in every
table, and what it finds is ranked by the exact inner product of the original vectors.

How many buckets a query looks into is found by measuring: ``SAMPLE`` of the queries, the bound of all that
is gathered, are compared with every row, and as many buckets are taken as bring ``RECALL`` of their true
neighbours. Where that needs all buckets, the search is exact. Every row is indexed, nothing is capped.

Equal vectors are one class of which the smallest ``k + 1`` ids are kept: no answer can need more. Rows of a
bucket beyond ``BUCKET_ROWS`` are dealt to further blocks, and each block is searched on its own, so a group of
near-equal vectors is never in one task; a task holds one block and lets the queries stream past it.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows
without an id; a shorter vector counts as filled up with zeros; equal (id, vector) rows count once; of one id
with several vectors each is searched for, and none of them is found for another; a query with fewer than
``k`` other rows gets all; an empty table gives an empty table; further columns are ignored. Sums are taken in
the order of the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.session import checkpointed

NEIGHBOURS = 20
EVERY = 20
TABLES = 6
BUCKET_ROWS = 1024
SAMPLE = 256
RECALL = 0.96
ROUNDS = 3
SALTS = 16
MOST_HASHES = 3
ROWS_AT_ONCE = 4096


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast transform of every row; the row length is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / math.sqrt(width)


class Hashes:
    """The rotations of all tables; the same in every task, as they come from a seed."""

    def __init__(self, size: int, axes: list[int], tables: int = TABLES, seed: int = 20240501) -> None:
        self.size, self.width, self.axes, self.tables = size, 1 << max(1, (size - 1).bit_length()), axes, tables
        draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (tables, len(axes), ROUNDS, self.width))
        self.signs = draw.astype(np.float64) * 2 - 1

    @property
    def buckets(self) -> int:
        return math.prod(2 * n for n in self.axes)

    def turned(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Per hash, how near each unit vector is to each signed axis."""
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / largest
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        filled = np.zeros((unit.shape[0], self.width))
        filled[:, : unit.shape[1]] = unit
        out = []
        for k, axes in enumerate(self.axes):
            rows = filled
            for signs in self.signs[table, k]:
                rows = hadamard(rows * signs)
            out.append(np.concatenate([rows[:, :axes], -rows[:, :axes]], axis=1))
        return out

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(vectors.shape[0], dtype=np.int64)
        for near in self.turned(vectors, table):
            code = code * near.shape[1] + near.argmax(axis=1)
        return code

    def probes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` likeliest buckets of each vector, likeliest first; fewer if there are no more."""
        at_once = max(1, (1 << 22) // (min(most, self.buckets) * 2 * self.width))
        if vectors.shape[0] > at_once:
            parts = range(0, vectors.shape[0], at_once)
            return np.concatenate([self.probes(vectors[at : at + at_once], table, most) for at in parts])
        score, code = np.zeros((vectors.shape[0], 1)), np.zeros((vectors.shape[0], 1), dtype=np.int64)
        for near in self.turned(vectors, table):
            # The best sums are made of the best of both sides.
            order = np.argsort(-near, axis=1, kind="stable")[:, :most]
            more = np.take_along_axis(near, order, axis=1)
            score = (score[:, :, None] + more[:, None, :]).reshape(score.shape[0], -1)
            code = (code[:, :, None] * near.shape[1] + order[:, None, :]).reshape(score.shape[0], -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            score, code = np.take_along_axis(score, best, axis=1), np.take_along_axis(code, best, axis=1)
        return code


def axes_for(rows: int, size: int, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Axes of each hash, so that a bucket holds ``bucket_rows`` rows on average; the first hash has all."""
    width = 1 << max(1, (size - 1).bit_length())
    axes, left = [width], rows / bucket_rows / (2 * width)
    while left > 1 and len(axes) < MOST_HASHES:
        axes.append(min(width, max(1, 1 << math.ceil(math.log2(left) - 1))))
        left /= 2 * axes[-1]
    return axes


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of one length, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((lengths.size, size))
    out[np.repeat(np.arange(lengths.size), lengths), np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component, so that they don't depend on the block's shape."""
    out = np.zeros((queries.shape[0], rows.shape[0]))
    for k in range(queries.shape[1]):
        out += np.multiply.outer(queries[:, k], rows[:, k])
    return out


def best_of(scores: np.ndarray, least_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of each line's ``k`` largest scores, ties to the smaller id."""
    if scores.shape[1] > k:
        bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        line, place = np.nonzero(scores >= bound)
    else:
        line, place = np.divmod(np.arange(scores.size), scores.shape[1])
    order = np.lexsort((least_ids[place], -scores[line, place], line))
    line, place = line[order], place[order]
    first = np.searchsorted(line, np.arange(scores.shape[0]))
    rank = np.arange(line.size) - first[line]
    return line[rank < k], place[rank < k]


def _take(batch: pa.RecordBatch, names: tuple[str, ...], rows) -> list[pa.Array]:
    return [batch.column(name).take(pa.array(rows)) for name in names]


def vector_classes(vectors: DataFrame, keep: int, every: int, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(``a, b, vec, ids, salts`` of every different vector; ``id, a, b, salt`` of every asking row).

    ``a, b`` is a hash of the vector, ``ids`` its ``keep`` smallest ids, ``salts`` the keys that its asking rows
    are dealt to. Rows of a hot vector are cut down or added up before they are shuffled.
    """
    kind = vectors.schema[embedding].dataType.elementType.typeName()
    vec = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & vec.isNotNull()).filter(finite & F.exists(vec, lambda x: x != 0))
    # Zeros at the end say nothing, and minus zero is zero.
    last = F.array_max(F.transform(vec, lambda x, at: F.when(x != 0, at + 1)))
    rows = rows.withColumn("vec", F.transform(F.slice(vec, F.lit(1), last), lambda x: x + F.lit(0).cast("float")))
    rows = rows.withColumns({"a": F.xxhash64(F.lit(1), vec), "b": F.xxhash64(F.lit(2), vec)})
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    asks = F.col("id") % every == 0
    narrow = rows.select("id", "a", "b").distinct()
    order = Window.partitionBy("a", "b").orderBy("id")
    ids = narrow.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    ids = ids.groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    once = rows.groupBy("a", "b").agg(F.first("vec").alias("vec"), F.collect_set(F.when(asks, salt)).alias("salts"))
    return once.join(ids, ["a", "b"]).select("a", "b", "vec", "ids", "salts"), narrow.filter(asks).withColumn("salt", salt)


def _true_neighbours(sample: np.ndarray, marks: np.ndarray, hashes: Hashes, k: int):
    """The nearest rows of a task to each sampled query, with their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((sample.shape[0], 0)), np.zeros((sample.shape[0], 0), np.int64), np.zeros((sample.shape[0], 0, hashes.tables), np.int64)]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = _matrix(part.column("vec"), hashes.size)
                own = marks[:, None] == part.column("a").to_numpy()[None, :]
                scores = np.concatenate([best[0], np.where(own, -np.inf, products(sample, rows))], axis=1)
                ids = part.column("least").to_numpy()
                ids = np.concatenate([best[1], np.broadcast_to(ids, own.shape)], axis=1)
                codes = np.stack([hashes.bucket(rows, table) for table in range(hashes.tables)], axis=1)
                codes = np.concatenate([best[2], np.broadcast_to(codes, (*own.shape, hashes.tables))], axis=1)
                order = np.lexsort((ids, -scores))[:, :k]
                best = [np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), np.take_along_axis(codes, order[:, :, None], 1)]
        query = np.repeat(np.arange(sample.shape[0]), best[0].shape[1])
        keep = np.isfinite(best[0].reshape(-1))
        cut = pa.array(np.arange(int(keep.sum()) + 1, dtype=np.int32) * hashes.tables)
        codes = pa.ListArray.from_arrays(cut, pa.array(best[2].reshape(-1, hashes.tables)[keep].reshape(-1)))
        columns = [pa.array(query[keep]), pa.array(best[0].reshape(-1)[keep]), pa.array(best[1].reshape(-1)[keep]), codes]
        yield pa.RecordBatch.from_arrays(columns, ["query", "score", "least", "codes"])

    return run


def fit_probes(classes: DataFrame, hashes: Hashes, k: int, sample: int = SAMPLE, recall: float = RECALL) -> int:
    """Buckets to look into per table, so that ``recall`` of the sampled queries' true neighbours are found."""
    rows = classes.filter(F.size("salts") > 0).orderBy("a", "b").limit(sample).select("a", "vec").collect()
    if not rows:
        return 1
    vectors = np.zeros((len(rows), hashes.size))
    for at, row in enumerate(rows):
        vectors[at, : len(row["vec"])] = row["vec"]
    marks = np.array([row["a"] for row in rows])
    found = classes.select("a", F.get("ids", F.lit(0)).alias("least"), "vec").mapInArrow(
        _true_neighbours(vectors, marks, hashes, k), "query long, score double, least long, codes array<long>"
    )
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    true = found.withColumn("at", F.row_number().over(nearest)).filter(F.col("at") <= k).select("query", "codes").collect()
    if not true:
        return 1
    query, codes = np.array([row["query"] for row in true]), np.array([row["codes"] for row in true])
    most = 32
    while True:
        at = np.full(query.size, most, dtype=np.int64)
        for table in range(hashes.tables):
            hit = hashes.probes(vectors, table, most)[query] == codes[:, table : table + 1]
            at = np.minimum(at, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        needed = int(np.sort(at)[math.ceil(recall * at.size) - 1]) + 1
        if needed <= most:
            return needed
        if most >= hashes.buckets:
            return hashes.buckets
        most = min(2 * most, hashes.buckets)


def _dealt(hashes: Hashes, most: int | None):
    """``a, b, tab, bucket``: each row's bucket in every table, or the ``most`` buckets it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vec"), hashes.size)
            for table in range(hashes.tables if rows.size else 0):
                codes = hashes.bucket(rows, table)[:, None] if most is None else hashes.probes(rows, table, most)
                who = np.repeat(np.arange(rows.shape[0]), codes.shape[1])
                tab = pa.array(np.full(who.size, table, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*_take(batch, ("a", "b"), who), tab, pa.array(codes.reshape(-1))], ["a", "b", "tab", "bucket"])

    return run


_CELL = ("tab", "bucket", "block")
_FOUND = "a long, b long, other_a long, other_b long, ids array<long>, score double"


def _search(size: int, keep: int):
    """Rows sorted by cell, its vectors before the queries: the best ``keep`` classes of a cell for each query."""

    def answers(held: list[pa.RecordBatch], asking: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = _matrix(known.column("vec"), size)
        least = pc.list_element(known.column("ids"), 0).to_numpy()
        for start in range(0, asking.num_rows, 256):
            part = asking.slice(start, 256)
            scores = products(_matrix(part.column("vec"), size), rows)
            line, place = best_of(scores, least, keep)
            columns = [*_take(part, ("a", "b"), line), *_take(known, ("a", "b", "ids"), place), pa.array(scores[line, place])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "other_a", "other_b", "ids", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in _CELL])
            cut = np.flatnonzero((np.diff(cells, axis=1) != 0).any(axis=0)) + 1
            for start, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                cell = tuple(cells[:, start].tolist())
                if cell != now:
                    now, held = cell, []
                part = batch.slice(start, end - start)
                known = int(part.num_rows - part.column("asks").true_count)
                if known:
                    held.append(part.slice(0, known))
                if known < part.num_rows and held:
                    yield from answers(held, part.slice(known))

    return run


def nearest(
    vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding",
    tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, sample: int = SAMPLE, recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row whose id ``every`` divides."""
    keep = k + 1
    classes, asking = vector_classes(vectors, keep, every, vec_id, embedding)
    classes = checkpointed(classes)
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("size")).first()
    size = about["size"] or 1
    hashes = Hashes(size, axes_for(about["n"], size, bucket_rows), tables)
    most = fit_probes(classes, hashes, k, sample, recall)
    dealt = "a long, b long, tab int, bucket long"
    placed = checkpointed(classes.select("a", "b", "vec").mapInArrow(_dealt(hashes, None), dealt))
    # Buckets of more than one block; salted, as the rows of a hot bucket all ask for its entry.
    full = placed.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * bucket_rows)
    full = full.select("tab", "bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    full = checkpointed(full)
    salted = lambda frame: frame.withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int")).join(full, ["tab", "bucket", "salt"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    known = salted(placed).select("a", "b", "tab", "bucket", F.pmod("b", blocks).cast("int").alias("block"), F.lit(False).alias("asks"))
    queries = classes.filter(F.size("salts") > 0)
    probes = salted(queries.select("a", "b", "vec").mapInArrow(_dealt(hashes, most), dealt))
    probes = probes.select("a", "b", "tab", "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks"))
    both = known.join(classes.select("a", "b", "vec", "ids"), ["a", "b"]).unionByName(
        probes.join(queries.select("a", "b", "vec", F.array().cast("array<long>").alias("ids")), ["a", "b"])
    )
    cells = both.repartition(*_CELL).sortWithinPartitions(*_CELL, "asks")
    found = cells.select(*_CELL, "asks", "a", "b", "vec", "ids").mapInArrow(_search(size, keep), _FOUND)
    # A class is found in several tables, with the same score.
    found = found.repartition("a", "b").groupBy("a", "b", "other_a", "other_b").agg(F.first("ids").alias("ids"), F.first("score").alias("score"))
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    found = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    found = found.select("a", "b", F.explode("ids").alias("id"), (-F.col("score")).alias("far"))
    found = found.groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, keep).alias("best"))
    answers = found.join(classes.select("a", "b", F.explode("salts").alias("salt")), ["a", "b"])
    own = asking.select(F.col("id").alias("query_id"), "a", "b", "salt").join(answers, ["a", "b", "salt"])
    others = F.slice(F.filter("best", lambda row: row["id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("at", "row"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("vec_id"), (-F.col("row.far")).alias("score"))
