"""Cross-entropy difference of documents under matched n-gram models of a target and a background text.

Tokens are the bytes of the UTF-8 text, so both models share one vocabulary of 256 whatever the languages.
A model interpolates orders 5, 3 and 1. Every n-gram is counted for itself: five bytes are a number of 40
bits, so keys are exact, and the tables of 5-grams grow with the text. The models are matched: same orders
and smoothing, background counts brought to the target's number of tokens.

The order of work: documents are put into chunks of about ``CHUNK`` bytes, one written row each. A chunk sends
its different 5-grams with their counts to parts that are dealt by a hash of the first four bytes, so that a
part has all 5-grams of a context. A part adds them up, knows the loss of each of its 5-grams under both models,
and answers every chunk with the losses of what that chunk sent. The chunk is then scored from its answers.
Neither a table of 5-grams nor a text leaves the tasks for the driver. Counts of three bytes, of which there can
be 2^24 and no more, are the only table that all tasks get (12 bytes an entry; 200 MB at that bound).

A document's score is its mean loss per token under the target model less that under the background
model; low scores mean target-like text.

Defined results: a null or empty text has no tokens and scores 0; with an empty target or background that
model is uniform; repeated rows are scored each; a text longer than a chunk is a chunk of its own, and memory
grows with the longest one; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.flat import mix
from fleetsight.session import checkpointed

ORDER = 5
SMOOTHING = 4.0
CHUNK = 1 << 21
BYTES = 256
TARGET = -1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at every token, as a number, and the number of tokens of every text.

    A text is preceded by four zero bytes, which only serve as context.
    """
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + text for text in texts), np.uint8)
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    if data.size < ORDER:
        return np.zeros(0, np.int64), sizes
    count = data.size - ORDER + 1
    five = data[:count].astype(np.int64)
    for k in range(1, ORDER):
        five <<= 8
        five |= data[k : k + count]
    own = np.ones(five.size, dtype=bool)
    starts = np.cumsum(sizes + ORDER - 1)[:-1]  # where the zero bytes of the next text begin
    for k in range(ORDER - 1):
        own[starts - (ORDER - 1) + k] = False
    return five[own], sizes


def dealt(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of each 5-gram, by its first four bytes."""
    return (mix((keys >> 8).view(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


def part_bits(spark: SparkSession) -> int:
    """Parts, as a power of two: several for each task of a shuffle."""
    return min(20, max(4, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def _ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by part, parts in that order); equal parts keep the keys' order."""
    part = dealt(keys, bits)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``CHUNK`` bytes of text: ids and texts as lists."""

    def out(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "texts"])

    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                yield out(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield out(ids, texts)


_SENT = "part long, chunk long, keys binary, counts binary"


def _send(bits: int):
    """The different 5-grams of each chunk with their counts, one row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts")):
                keys, counts = np.unique(grams(texts.as_py())[0], return_counts=True)
                order, part = _ordered(keys, bits)
                keys, counts = keys[order], counts[order]
                cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if part.size else np.zeros(1, np.int64)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                bodies = [pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()) for values in (keys, counts)]
                columns = [pa.array(part[cut[:-1]]), pa.array(np.full(len(spans), chunk, dtype=np.int64)), *bodies]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "keys", "counts"])

    return run


def _threes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in batch.column("texts"):
            keys, counts = np.unique(grams(texts.as_py())[0] & 0xFFFFFF, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["three", "n"])


class Lower:
    """Exact counts of three bytes, from which those of two and of one follow."""

    def __init__(self, threes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(threes)
        self.threes, self.counts = threes[order].astype(np.uint32), counts[order].astype(np.float64)
        self.contexts = np.bincount(self.threes >> 8, self.counts, 1 << 16)
        self.bytes = np.bincount(self.threes & 0xFF, self.counts, BYTES)
        self.tokens = float(self.counts.sum())

    def chance(self, keys: np.ndarray, scale: float) -> np.ndarray:
        """Chance of the last byte of each 5-gram by the two bytes before it."""
        three = (keys & 0xFFFFFF).astype(np.uint32)
        found = np.zeros(keys.size)
        if self.threes.size:
            at = np.minimum(np.searchsorted(self.threes, three), self.threes.size - 1)
            found = np.where(self.threes[at] == three, self.counts[at], 0.0)
        one = (self.bytes[three & 0xFF] * scale + 1) / (self.tokens * scale + BYTES)
        return (found * scale + SMOOTHING * one) / (self.contexts[three >> 8] * scale + SMOOTHING)


def lower_counts(chunks: DataFrame) -> Lower:
    """Counts of three bytes over all texts: at most 2^24 rows."""
    rows = chunks.select("texts").mapInArrow(_threes, "three long, n long").groupBy("three").agg(F.sum("n").alias("n")).toArrow()
    return Lower(rows.column("three").to_numpy(), rows.column("n").to_numpy())


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), found.size)


def losses(asked: np.ndarray, model: tuple[np.ndarray, np.ndarray], lower: Lower, scale: float) -> np.ndarray:
    """Loss of each asked 5-gram (in order); ``model`` has all 5-grams of their contexts with counts."""
    keys, counts = model
    contexts = keys >> 8
    ends = np.append(0.0, np.cumsum(counts))
    wanted = asked >> 8
    held = ends[np.searchsorted(contexts, wanted, "right")] - ends[np.searchsorted(contexts, wanted, "left")]
    found = ends[np.searchsorted(keys, asked, "right")] - ends[np.searchsorted(keys, asked, "left")]
    chance = (found * scale + SMOOTHING * lower.chance(asked, scale)) / (held * scale + SMOOTHING)
    return -np.log(chance)


_ANSWER = "chunk long, part long, target binary, background binary"


def _answer(lowers, scale: float):
    """Rows sorted by part: the losses of the 5-grams of each chunk, in the order they were sent."""

    def out(part: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        models = [_summed([k for c, k, _ in held if (c == TARGET) == aim], [n for c, _, n in held if (c == TARGET) == aim]) for aim in (True, False)]
        asked = models[1][0]
        found = [losses(asked, model, lower, s).astype(np.float32) for model, lower, s in zip(models, lowers.value, (1.0, scale))]
        chunks = [(chunk, np.searchsorted(asked, keys)) for chunk, keys, _ in held if chunk != TARGET]
        for at in range(0, len(chunks), 64):
            some = chunks[at : at + 64]
            bodies = [pa.array([values[places].tobytes() for _, places in some], pa.binary()) for values in found]
            columns = [pa.array([chunk for chunk, _ in some], pa.int64()), pa.array([part] * len(some), pa.int64()), *bodies]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, chunk, keys, counts in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("keys"), batch.column("counts")):
                if part != now and held:
                    yield from out(now, held)
                    held = []
                now = part
                held.append((chunk, np.frombuffer(keys.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64)))
        if held:
            yield from out(now, held)

    return run


_NAMES = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _scored(bits: int):
    """One chunk and its answers: mean losses of its texts."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3], names=_NAMES)
        ids, texts = chunk.column("ids")[0].as_py(), chunk.column("texts")[0].as_py()
        found, sizes = grams(texts)
        keys, at = np.unique(found, return_inverse=True)
        order, _ = _ordered(keys, bits)
        answers = answers.sort_by("part")
        ends, means = np.cumsum(sizes), []
        for name in ("target", "background"):
            loss = np.zeros(keys.size)
            loss[order] = np.frombuffer(b"".join(answers.column(name).to_pylist()), np.float32)
            running = np.append(0.0, np.cumsum(loss[at]))
            means.append((running[ends] - running[ends - sizes]) / np.maximum(sizes, 1))
        columns = [pa.array(ids, pa.int64()), pa.array(sizes), *[pa.array(v) for v in (*means, means[0] - means[1])]]
        return pa.table(columns, names=_NAMES)

    return run


def _chunks(texts: DataFrame) -> DataFrame:
    """``chunk, ids, texts``, written once, so that all passes see the same chunks."""
    made = texts.mapInArrow(_chunked, "ids array<long>, texts array<binary>")
    return checkpointed(made.select(F.monotonically_increasing_id().alias("chunk"), "ids", "texts"))


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` per document.

    The background is all of ``docs``; ``target`` is any table with a column ``text``.
    """
    spark, bits = docs.sparkSession, part_bits(docs.sparkSession)
    chosen = _chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    aim = _chunks(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    lowers = lower_counts(aim), lower_counts(chosen)
    have, want = lowers[1].tokens, lowers[0].tokens
    scale = want / have if have and want else 1.0
    shared = spark.sparkContext.broadcast(lowers)
    sent = chosen.select("chunk", "texts").unionByName(aim.select(F.lit(TARGET).cast("long").alias("chunk"), "texts")).mapInArrow(_send(bits), _SENT)
    answers = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_answer(shared, scale), _ANSWER)
    return chosen.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(bits), _SCORES)
