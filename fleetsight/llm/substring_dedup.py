"""Exact substring de-duplication with fixed-block anchors.

Documents are taken in batches of neighbouring ids, cut by size. Every batch lists its reference blocks (the
non-overlapping blocks of ``block`` words of each document) and all its rolling windows of ``block``
words, by hash. Hash buckets tell a batch which of its reference blocks some other batch's rolling
windows hit. Any repeat of at least ``2 * block - 1`` words holds a whole reference block of each of its
copies, so only windows over a hit block can repeat. Those are extended: all windows of ``window``
words that cover a hit block are compared by 96 bits of hash, and consecutive repeated windows make
up the maximal repeat. The batch with the smallest ids owns a window; all later starts are removed.

Between batches only hashes travel, each once per batch, so a passage that fills a third of the corpus
costs one entry per batch. The text is shuffled once and that exchange is read by all steps.

Defined results: a null or empty text has no words; texts shorter than a window keep everything;
repeated rows and repeated ids are documents of their own, ordered by (id, text), a null id first.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.flat import CHUNK_BYTES, Flat, chunks, distinct, member, whole_windows, window_hashes, window_hashes_at

WINDOW = 20
# Words of a batch and of a hash bucket; both grow with the root of the corpus beyond that, so that a
# batch has at least 64 hashes for each bucket.
BATCH_WORDS = 600_000
BUCKET_WORDS = 4_000_000

_ANCHORS = "bucket long, batch long, wide boolean, probes binary, blocks binary"
_MESSAGES = "batch long, kind int, bucket long, body binary"
_WINDOWS = "bucket long, batch long, high binary, low binary"
_EMPTY = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary())])


def _pieces(frame: DataFrame, limit: int) -> list[tuple[int | None, str | None, int]]:
    """(id, text, size) of the first of neighbouring rows that hold ``limit`` at most, in order; a larger row stands alone.

    ``frame`` has distinct ``id, text`` with a ``size``; a piece with texts is of one id. Only piece starts come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            for number, text, size in zip(*(batch.column(name).to_pylist() for name in ("id", "text", "size"))):
                if held and held[-1][2] + size <= limit and (text is None or held[-1][0] == number):
                    held[-1][2] += size
                else:
                    held.append([number, text, size])
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[k] for row in held], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], ["id", "text", "size"]
        )

    dealt = frame.select("id", "text", "size").repartitionByRange("id", "text").sortWithinPartitions("id", "text")
    rows = [tuple(row) for row in dealt.mapInArrow(run, "id long, text string, size long").collect()]
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, (row[1] or "").encode()))
    out: list[tuple[int | None, str | None, int]] = []
    for number, text, size in rows:  # the ends of partitions
        if out and out[-1][2] + size <= limit and (text is None or out[-1][0] == number):
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((number, text, size))
    return out


class Layout:
    """How documents are cut into batches and hashes into buckets; from the sizes of ids and of the corpus.

    Batches follow the order of ids and hold about the same number of bytes, however ids are spread. An id that is
    larger than a batch, null too, is cut by text; equal rows that are larger are dealt out.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str) -> None:
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        size = F.sum(F.octet_length("text") + 1).alias("size")
        words = max(1, (rows.agg(size).first()[0] or 0) // 6)
        grown = int(math.sqrt(64 * words))
        limit = 6 * max(BATCH_WORDS, grown)
        self.buckets = max(8, -(-words // max(BUCKET_WORDS, grown)))
        # A null id is a batch of its own, before all others.
        found = _pieces(rows.filter("id IS NOT NULL").groupBy("id").agg(size).withColumn("text", F.lit(None).cast("string")), limit)
        self.starts = np.array([number for number, _, _ in found], dtype=np.int64)
        large = [number for number, _, held in found if held > limit]
        self.is_large = lambda column: column.isin(large) if large else F.lit(False)
        if (rows.filter("id IS NULL").agg(size).first()[0] or 0) > limit:
            is_known = self.is_large
            self.is_large = lambda column: column.isNull() | is_known(column)
            large.append(None)
        # Per large id: the texts that begin its parts, the first batch of each part and their number.
        self.parts: dict[int | None, tuple[list[bytes], list[int], list[int]]] = {}
        if large:
            hot = rows.filter(self.is_large(F.col("id"))).groupBy("id", "text").agg(size)
            for number, text, held in _pieces(hot, limit):
                texts, firsts, widths = self.parts.setdefault(number, ([], [], []))
                firsts.append(firsts[-1] + widths[-1] if firsts else 0)
                widths.append(-(-held // limit))
                texts.append(text.encode())

    def batch(self, doc_id: str, text: str) -> Column:
        starts, parts = self.starts, self.parts

        def number(ids: pa.Array, texts: pa.Array) -> pa.Array:
            known = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            out = np.searchsorted(starts, known, side="right") << 24
            out[ids.is_null().to_numpy(zero_copy_only=False)] = -1 << 24
            for k in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                begins, firsts, widths = parts[ids[k].as_py()]
                part = max(0, bisect_right(begins, texts[k].as_py().encode()) - 1)
                out[k] += firsts[part] + k % widths[part]
            return pa.array(out)

        wanted = F.col(doc_id).cast("long")
        shown = F.when(self.is_large(wanted), F.coalesce(F.col(text).cast("string"), F.lit("")))
        return F.arrow_udf(number, "long")(wanted, shown)


class Batch:
    """The documents of one batch in order, with the hashes of all their words."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").to_pylist()
        given = table.column("text").to_pylist()
        texts = [text or "" for text in given]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.texts, self.given = [texts[i] for i in self.order], [given[i] for i in self.order]
        hashes, first, seen = [], [], 0
        for _, part in chunks(self.texts, CHUNK_BYTES):
            flat = Flat(part)
            starts, ends = flat.words()
            first.append(flat.first_of(starts)[:-1] + seen)
            hashes.append(flat.hashes(starts, ends))
            seen += starts.size
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([*first, [seen]]).astype(np.int64)

    def block_keys(self, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket and 32 bits of hash, is within one document, is a reference block) per rolling window."""
        keys = bucket_keys(window_hashes(self.words, block), buckets)
        inside = whole_windows(self.first, keys.size, block)
        place = np.arange(self.words.size) - np.repeat(self.first[:-1], np.diff(self.first))
        return keys, inside, inside & (place[: keys.size] % block == 0)

    def windows(self, hits: np.ndarray, block: int, window: int, buckets: int):
        """Starts of the windows over hit blocks, and their distinct hashes in (bucket, hash) order."""
        keys, inside, reference = self.block_keys(block, buckets)
        ordered = np.sort(keys[inside])
        twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.flatnonzero(reference)
        hit = at[member(keys[at], distinct(np.concatenate([hits, twice])))]
        n = max(0, self.words.size - window + 1)
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, np.clip(hit - (window - block), 0, n), 1)
        np.add.at(edge, np.clip(hit + 1, 0, n), -1)
        starts = np.flatnonzero((np.cumsum(edge[:n]) > 0) & whole_windows(self.first, n, window))
        high = window_hashes_at(self.words, starts, window, False)
        low = (window_hashes_at(self.words, starts, window, True) >> np.uint64(32)).astype(np.uint32)
        bucket = high % np.uint64(buckets)
        order = np.lexsort((starts, low, high, bucket))
        new = np.ones(order.size, dtype=bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        return starts[order], new, high[order][new], low[order][new], bucket[order][new].astype(np.int64)


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows) if rows else [[]] * len(schema), schema)],
        schema=schema,
    )


def _send_anchors(block: int, buckets: int):
    schema = pa.schema(
        [("bucket", pa.int64()), ("batch", pa.int64()), ("wide", pa.bool_()), ("probes", pa.binary()), ("blocks", pa.binary())]
    )

    def send(table: pa.Table) -> pa.Table:
        batch = Batch(table)
        keys, inside, reference = batch.block_keys(block, buckets)
        probes, blocks = distinct(keys[inside]), distinct(keys[reference])
        cut, cut_blocks = _split(probes, buckets), _split(blocks, buckets)
        number, rows = table.column("batch")[0].as_py(), []
        for bucket in np.flatnonzero(np.diff(cut)):
            values = probes[cut[bucket] : cut[bucket + 1]].astype(np.uint32)
            steps = np.diff(values, prepend=np.uint32(0))
            wide = bool(steps.max() > 0xFFFF)
            held = blocks[cut_blocks[bucket] : cut_blocks[bucket + 1]].astype(np.uint32)
            rows.append((int(bucket), number, wide, (steps if wide else steps.astype(np.uint16)).tobytes(), held.tobytes()))
        return _table(rows, schema)

    return send


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Reference blocks that rolling windows of at least two batches hold."""
    sets = [
        np.cumsum(np.frombuffer(body, np.uint32 if wide else np.uint16), dtype=np.uint32)
        for body, wide in zip(table.column("probes").to_pylist(), table.column("wide").to_pylist())
    ]
    seen = np.sort(np.concatenate(sets))
    shared = distinct(seen[1:][seen[1:] == seen[:-1]])
    rows = []
    for bucket, batch, body in zip(*(table.column(name).to_pylist() for name in ("bucket", "batch", "blocks"))):
        blocks = np.frombuffer(body, np.uint32)
        blocks = blocks[member(blocks, shared)]
        if blocks.size:
            rows.append((batch, 0, bucket, blocks.tobytes()))
    return _table(rows, _EMPTY)


def _hits(messages: pa.Table) -> np.ndarray:
    parts = [
        (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(body, np.uint32).astype(np.uint64)
        for kind, bucket, body in zip(*(messages.column(name).to_pylist() for name in ("kind", "bucket", "body")))
        if kind == 0
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _send_windows(block: int, window: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])

    def send(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], schema)
        _, _, high, low, bucket = Batch(table).windows(_hits(messages), block, window, buckets)
        number = table.column("batch")[0].as_py()
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [
            (int(b), number, high[cut[b] : cut[b + 1]].tobytes(), low[cut[b] : cut[b + 1]].tobytes())
            for b in np.flatnonzero(np.diff(cut))
        ]
        return _table(rows, schema)

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """Per batch a bit for each of its windows: does a batch of smaller ids have it too?"""
    high = [np.frombuffer(body, np.uint64) for body in table.column("high").to_pylist()]
    low = np.concatenate([np.frombuffer(body, np.uint32) for body in table.column("low").to_pylist()])
    batches = np.array(table.column("batch").to_pylist(), dtype=np.int64)
    sizes = np.array([part.size for part in high])
    high = np.concatenate(high)
    order = np.lexsort((np.repeat(batches, sizes), low, high))
    later = np.zeros(order.size, dtype=bool)
    later[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    cut = np.concatenate([[0], np.cumsum(sizes)])
    bucket = table.column("bucket")[0].as_py()
    rows = [
        (int(batch), 1, bucket, np.packbits(later[a:b]).tobytes())
        for batch, a, b in zip(batches, cut[:-1], cut[1:])
        if later[a:b].any()
    ]
    return _table(rows, _EMPTY)


def _remove(block: int, window: int, buckets: int, schema: pa.Schema):
    def cut_text(text: str, covered: np.ndarray) -> str:
        """The text without its covered words and the white space after each of them."""
        flat = Flat([text.encode()])
        starts, _ = flat.words()
        ends = np.append(starts[1:], flat.data.size - 1)
        keep = np.ones(flat.data.size - 1, dtype=bool)
        for a, b in zip(*flat.runs(covered)):
            keep[starts[a] : ends[b - 1]] = False
        return flat.data[:-1][keep].tobytes().decode()

    def remove(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        batch = Batch(table)
        starts, new, _, _, bucket = batch.windows(_hits(messages), block, window, buckets)
        later = np.zeros(bucket.size, dtype=bool)
        for kind, number, body in zip(*(messages.column(name).to_pylist() for name in ("kind", "bucket", "body"))):
            if kind == 1:
                a, b = np.searchsorted(bucket, [number, number + 1])
                later[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
        # Starts are in order within a hash: all but the first are repeats, that one if an earlier batch has it.
        gone = starts[~new | later[np.cumsum(new) - 1]] if starts.size else starts
        edge = np.zeros(batch.words.size + 1, dtype=np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        n_words, n_removed, digests, texts = [], [], [], []
        for text, given, a, b in zip(batch.texts, batch.given, batch.first[:-1], batch.first[1:]):
            mask, words = covered[a:b], text.encode().split()
            removed = int(mask.sum())
            kept = [word for word, out in zip(words, mask) if not out] if removed else words
            n_words.append(len(words))
            n_removed.append(removed)
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            texts.append(cut_text(text, mask) if removed else given)
        place = np.empty(len(batch.order), dtype=np.int64)
        place[batch.order] = np.arange(len(batch.order))
        found = {"n_words": n_words, "n_removed": n_removed, "kept_sha256": digests, "kept_text": texts}
        arrays = [
            pa.array(found[field.name], field.type).take(pa.array(place))
            if field.name in found
            else table.column(field.name).combine_chunks().cast(field.type)
            for field in schema
        ]
        return pa.Table.from_arrays(arrays, schema=schema)

    return remove


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_rows: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words over it also starts earlier (smaller id, or earlier in
    the same document). ``kept_sha256`` is of the kept words joined by one blank. With ``with_rows`` the
    whole input row comes as the struct ``row`` and the text without the removed words as ``kept_text``;
    an untouched text stays as it was.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    block = (window + 1) // 2
    layout = Layout(docs, doc_id, text)
    columns = [
        layout.batch(doc_id, text).alias("batch"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    ]
    if with_rows:
        columns.append(F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != text]).alias("row"))
    batches = docs.select(*columns)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    if with_rows:
        schema = schema.add("row", batches.schema["row"].dataType).add("kept_text", "string")
    buckets = layout.buckets

    anchors = batches.groupBy("batch").applyInArrow(_send_anchors(block, buckets), _ANCHORS)
    hits = anchors.groupBy("bucket").applyInArrow(_answer_anchors, _MESSAGES)
    windows = (
        batches.groupBy("batch")
        .cogroup(hits.groupBy("batch"))
        .applyInArrow(_send_windows(block, window, buckets), _WINDOWS)
    )
    later = windows.groupBy("bucket").applyInArrow(_answer_windows, _MESSAGES)
    return (
        batches.groupBy("batch")
        .cogroup(hits.unionByName(later).groupBy("batch"))
        .applyInArrow(_remove(block, window, buckets, to_arrow_schema(schema)), schema)
    )
