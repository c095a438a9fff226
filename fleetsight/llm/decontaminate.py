"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments of up to ``SEGMENT`` characters and, for quotes of a part, into
passages of ``PASSAGE`` characters every ``PASSAGE_STEP``: ``SURE`` verbatim characters of an item, or all of a
shorter one, are surely found, however they lie in it. A segment of ``m``
characters that lies in a text with at most ``e`` edits shares at least ``m - q + 1 - q * e`` of its
character q-grams with it, and they lie within ``e`` diagonals. So: text places whose window holds too few
benchmark q-grams are skipped; for the others the hits are looked up and counted in overlapping diagonal
bands of ``2 e`` diagonals, ``e`` apart; bands that reach the bound are aligned, within the band only. Segments that several items share are one, and
a stretch that a text repeats is looked at once; index entries are taken a slice at a time, so that memory
does not grow with a line that many items begin with.

Texts and items are compared in lower case with white space runs as one blank. Segments are handled in
blocks of ``SEGMENTS_AT_ONCE``, each a pass over the documents, so a large benchmark needs no large
broadcast.

Defined results: null and empty texts match nothing; items shorter than ``Q`` characters (after white
space is reduced) can share no q-gram and are not searched; equal items are all reported; repeated
documents are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.flat import mix

Q = 8
SEGMENT = 160
STEP = 80
# Passages: short segments, for quotes of a part of an item.
PASSAGE = 64
PASSAGE_STEP = 12
# Characters of an item that are surely found wherever they begin and end, if they are verbatim.
SURE = PASSAGE + PASSAGE_STEP - 1
EDIT_SHARE = 0.08
SEGMENTS_AT_ONCE = 20_000
CHARS_AT_ONCE = 1 << 20
TABLE_BITS = 22
ALIGNED_AT_ONCE = 512
# Index entries that are looked at together, and bits of a place within a segment.
ENTRIES = 1 << 20
PLACE_BITS = 8
# Stands between texts; no q-gram of a segment holds it.
_GAP = "￿"
_GAP_CODE = ord(_GAP)
_DOUBLE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().replace(_GAP, " ").split())


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every q-gram, made of halves twice as long each time; ``Q`` is 8."""
    if codes.size < Q:
        return np.zeros(0, dtype=np.uint64)
    held, reach = codes.astype(np.uint64), 1
    for weight in _DOUBLE[:-1]:
        left = held[:-reach] * weight
        left += held[reach:]
        held, reach = left, 2 * reach
    held *= _DOUBLE[-1]
    return held


def budget(length: int) -> int:
    """Edits allowed for a segment, at most so many that one shared q-gram is still needed."""
    return min(int(EDIT_SHARE * length), (length - Q) // Q)


def segments(items: Sequence[tuple[int, str]]) -> list[tuple[int, str]]:
    """(item, piece of its plain text): whole, or every ``STEP`` characters and the last."""
    out = []
    for item, text in items:
        text = plain(text)
        last = len(text) - SEGMENT
        for start in [*range(0, max(last, 0), STEP), max(last, 0)]:
            if len(text) >= Q:
                out.append((item, text[start : start + SEGMENT]))
    return out


def passages(items: Sequence[tuple[int, str]]) -> list[tuple[int, str]]:
    """(item, piece of its plain text): ``PASSAGE`` characters every ``PASSAGE_STEP`` and the last; none of items that short."""
    out = []
    for item, text in items:
        text = plain(text)
        last = len(text) - PASSAGE
        if last > 0:
            out.extend((item, text[start : start + PASSAGE]) for start in [*range(0, last, PASSAGE_STEP), last])
    return out


def first_places(hashes: np.ndarray, hit: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """Which hits are the first of their text between q-grams that are the same ``reach`` far on both sides.

    What such a place can begin or end is found at the first one, with as few edits and further to the front.
    """
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(hashes.size, _DOUBLE[1])]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    low, high = np.maximum(hit - reach, 0), np.minimum(hit + reach + 1, hashes.size)
    around = (total[high] - total[low]) * power[hashes.size - low]
    # At the edges of what is searched, places differ by what is cut off.
    around ^= mix(mix(text.astype(np.uint64)) + ((hit - low) * (2 * reach + 2) + high - hit).astype(np.uint64))
    first = np.zeros(hit.size, dtype=bool)
    first[np.unique(around, return_index=True)[1]] = True
    return first


class Patterns:
    """Segments of about equal length with their q-gram index; equal segments of several items are one."""

    def __init__(self, pieces: list[tuple[int, str]]) -> None:
        owners: dict[str, list[int]] = {}
        for item, piece in pieces:
            owners.setdefault(piece, []).append(item)
        self.items = list(owners.values())
        self.codes = [letters(piece) for piece in owners]
        self.sizes = np.array([codes.size for codes in self.codes])
        self.edits = np.array([budget(size) for size in self.sizes])
        self.bound = self.sizes - Q + 1 - Q * self.edits
        grams = [gram_hashes(codes) for codes in self.codes]
        hashes = np.concatenate(grams)
        owner = np.repeat(np.arange(len(grams)), [g.size for g in grams])
        place = np.concatenate([np.arange(g.size) for g in grams])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        # Text window that holds all q-grams of an occurrence of any of the segments.
        self.window = int((self.sizes - Q + 1 + self.edits).max())
        self.least = int(self.bound.min())

    def matches(self, text: np.ndarray, hashes: np.ndarray, hit: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(segment, edits, start, end) of the best alignment per segment and band; ``hit``: likely q-grams."""
        if hit.size < self.least:
            return
        # A hit counts if some window of the text with enough hits covers it.
        reach = np.searchsorted(hit, hit + self.window) - np.arange(hit.size)
        edge = np.zeros(hit.size + 1, dtype=np.int64)
        dense = np.flatnonzero(reach >= self.least)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + reach[dense], -1)
        hit = hit[np.cumsum(edge[:-1]) > 0]
        hit = hit[first_places(hashes, hit, np.searchsorted(ends, hit, side="right"), self.window)]
        low, high = np.searchsorted(self.hashes, hashes[hit], "left"), np.searchsorted(self.hashes, hashes[hit], "right")
        found = np.cumsum(high - low)
        at = 0
        # A slice has ENTRIES index entries, and those of the window behind it.
        while at < hit.size:
            before = found[at - 1] if at else 0
            core = max(at + 1, int(np.searchsorted(found, before + ENTRIES, "right")))
            end = int(np.searchsorted(hit, hit[core - 1] + self.window, "right")) if core < hit.size else core
            yield from self._aligned(text, hit[at:end], low[at:end], high[at:end])
            at = core

    def _aligned(self, text: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        counts = high - low
        if not counts.sum():
            return
        entry = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        owner, gram = self.owner[entry], self.place[entry]
        # Each diagonal lies in two bands; a q-gram of the segment counts once in a band.
        band = (np.repeat(hit, counts) - gram + SEGMENT) // np.maximum(self.edits[owner], 1)
        width = int(band.max()) + 2
        key = ((owner * width + band + 1) << PLACE_BITS) | gram
        key = np.sort(np.concatenate([key, key - (1 << PLACE_BITS)]))
        key = key[np.diff(key, prepend=-1) != 0] >> PLACE_BITS
        new = np.flatnonzero(np.diff(key, prepend=-1))
        which, band = np.divmod(key[new], width)
        enough = np.diff(np.append(new, key.size)) >= self.bound[which]
        which, band = which[enough], band[enough] - 1
        for at in range(0, which.size, ALIGNED_AT_ONCE):
            some, edits = which[at : at + ALIGNED_AT_ONCE], self.edits[which[at : at + ALIGNED_AT_ONCE]]
            first = band[at : at + ALIGNED_AT_ONCE] * np.maximum(edits, 1) - SEGMENT
            places = banded([self.codes[k] for k in some.tolist()], text, first, edits)
            yield from ((k, *found) for k, found in zip(some.tolist(), places) if found is not None)


def banded(
    patterns: Sequence[np.ndarray], text: np.ndarray, first: np.ndarray, edits: np.ndarray
) -> list[tuple[int, int, int] | None]:
    """Per pattern (edits, start, end) of its best place in the text near its band of diagonals.

    A band has ``2 * edits + 1`` diagonals from ``first`` on, and ``edits`` more on each side; all patterns
    are aligned side by side, row by row, a lane for each diagonal. Start is free along the first row and
    end along the last; None if more than ``edits`` are needed. No alignment goes over the gap between texts.
    """
    sizes = np.array([codes.size for codes in patterns])
    allowed = np.maximum(edits, 1)
    far = np.int64(1 << 40)
    lane = np.arange(int((2 * allowed + 2 * edits).max()) + 1)
    lanes = (first - edits)[:, None] + lane
    valid = lane <= (2 * allowed + 2 * edits)[:, None]
    letter_at = np.zeros((len(patterns), int(sizes.max())), dtype=text.dtype)
    for k, codes in enumerate(patterns):
        letter_at[k, : codes.size] = codes
    cost = np.where(valid & (lanes >= 0) & (lanes <= text.size), 0, far)
    start = lanes.copy()
    edge = np.full((len(patterns), 1), far)
    out: list[tuple[int, int, int] | None] = [None] * len(patterns)
    for row in range(1, letter_at.shape[1] + 1):
        at = lanes + row  # end in the text
        inside = valid & (at >= 0) & (at <= text.size)
        known = inside & (at >= 1)
        letter = text[np.where(known, at - 1, 0)]
        gap = known & (letter == _GAP_CODE)
        take = np.where(known & ~gap, cost + (letter != letter_at[:, row - 1 : row]), far)
        skip = np.concatenate([cost[:, 1:], edge], axis=1) + 1  # a letter of the pattern is missing in the text
        begin = np.where(skip < take, np.concatenate([start[:, 1:], edge], axis=1), start)
        # Letters of the text that the pattern lacks: lanes further right at one edit each.
        # Each gap lowers all that follows it by more than any cost, so that nothing before it is taken over.
        lower = lane + (np.cumsum(gap, axis=1) << 42)
        run = np.where(inside, np.minimum(take, skip), far) - lower
        least = np.minimum.accumulate(run, axis=1)
        source = np.maximum.accumulate(np.where(run == least, lane, 0), axis=1)
        cost = np.where(inside, least + lower, far)
        start = np.take_along_axis(begin, source, axis=1)
        for k in np.flatnonzero(sizes == row).tolist():
            best = int(np.argmin(cost[k]))
            if cost[k, best] <= edits[k]:
                out[k] = (int(cost[k, best]), int(start[k, best]), int(lanes[k, best] + row))
    return out


class Index:
    """Segments in classes of length, so that a short one doesn't lower the bound of the long ones."""

    def __init__(self, pieces: list[tuple[int, str]]) -> None:
        by: dict[int, list[tuple[int, str]]] = {}
        for item, piece in pieces:
            by.setdefault(min(7, int(4 * np.log2(len(piece) / Q)) // 3), []).append((item, piece))
        self.classes = [Patterns(group) for _, group in sorted(by.items())]
        # Per hash prefix a bit for each class that has such a q-gram.
        self.table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
        for bit, patterns in enumerate(self.classes):
            self.table[np.unique(patterns.hashes >> np.uint64(64 - TABLE_BITS))] |= np.uint8(1 << bit)

    def matches(self, text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, start, end) per segment and band that reach the bound; texts end before ``ends``."""
        hashes = gram_hashes(text)
        bits = self.table[(hashes >> np.uint64(64 - TABLE_BITS)).view(np.int64)]
        hit = np.flatnonzero(bits)
        bits = bits[hit]
        for bit, patterns in enumerate(self.classes):
            for which, *found in patterns.matches(text, hashes, hit[bits & (1 << bit) != 0], ends):
                for item in patterns.items[which]:
                    yield (item, *found)


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for place, text in enumerate(texts):
        held.append(plain(text))
        size += len(held[-1])
        if size >= CHARS_AT_ONCE:
            yield start, held
            start, held, size = place + 1, [], 0
    if held:
        yield start, held


def find(texts: Sequence[str | None], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) with the fewest edits per text and item; places in the plain text."""
    for first, part in _chunks(texts):
        ends = np.cumsum([len(text) + 1 for text in part])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, edits, start, end in index.matches(letters(_GAP.join(part) + _GAP), ends):
            number = int(np.searchsorted(ends, start, side="right"))
            begin = int(ends[number]) - len(part[number]) - 1
            key, found = (first + number, item), (edits, start - begin, end - begin)
            best[key] = min(best.get(key, found), found)
        for (number, item), found in sorted(best.items()):
            yield (number, item, *found)


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's segments a block at a time; the driver holds one block."""
    held: list[tuple[int, str]] = []
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if item is not None:
            held.extend(segments([(item, text)]) + passages([(item, text)]))
        while len(held) >= SEGMENTS_AT_ONCE:
            yield Index(held[:SEGMENTS_AT_ONCE])
            held = held[SEGMENTS_AT_ONCE:]
    if held:
        yield Index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, start_char, end_char``: documents with a passage of a benchmark item.

    One row per document row and item: the segment with the fewest edits, then the first in the text;
    places count characters of the plain text.
    """
    schema = "doc_id long, item_id long, edits int, start_char long, end_char long"
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def searcher(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(find(batch.column("text").to_pylist(), index))
                number, item, edits, start, end = (pa.array(v, pa.int64()) for v in (zip(*rows) if rows else [[]] * 5))
                ids = batch.column("doc_id").take(number)
                yield pa.RecordBatch.from_arrays([ids, item, edits.cast(pa.int32()), start, end], ["doc_id", "item_id", "edits", "start_char", "end_char"])

        return run

    parts = [chosen.mapInArrow(searcher(index), schema) for index in _blocks(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(parts) == 1:
        return out
    # An item cut by a block's edge is found in both.
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_char", "end_char")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with their columns as they came."""
    kept = docs
    for index in _blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, dtype=bool)
                for row in find(batch.column("text").to_pylist(), index):
                    bad[row[0]] = True
                yield batch.filter(pa.array(~bad))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
