"""Collocations by stripes: each prefix keys a counter of the words that follow it.

Everything is per language. A stripe is a prefix of one to three words, the number of its occurrences and a
counter of its next words. Tasks make stripes of chunks of text, stripes of one prefix are merged element by
element, and all that a phrase needs is read from the merged ones: extensions are the candidates, totals the
counts of their parts, and the largest extension says whether a longer phrase subsumes a shorter one. (A
phrase that subsumes another by two words more has one between them that does so too, so one word is enough.)

A phrase of ``LEAST_COUNT`` occurrences has no rarer part. So a first pass counts single words and pairs by
hash, and a Bloom filter of the frequent ones keeps most others out of the stripes: what it lets through too
much costs room and is counted and dropped like everything else, so counts are exact whatever the filter's
size. The filter is broadcast and has ``FILTER_BITS`` bits (16 MB) at most; nothing else goes to all tasks.

A prefix's stripe is split by a hash of the next word into ``SLOTS`` parts, so that no task holds all
followers of a frequent word, and memory is bounded by one part and by a chunk, or one longer text.

Defined results: a null text counts as empty, a null language as ``und``; ASCII letters are compared in lower
case; a text of any length is counted whole; repeated rows count each; further columns are ignored; an empty
table gives an empty table. Words are told apart by 64 bits of hash inside a chunk and by text across chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsight.llm.flat import Flat, mix, window_hashes
from fleetsight.session import checkpointed

LEAST_COUNT = 30
LONGEST = 4
SUBSUMED = 80
BEST = 2000
SCALE = 2_000_000

CHUNK = 1 << 22
MERGE_ROWS = 1 << 20
CELL_BITS = 32
FILTER_BITS = 27
SLOTS = {0: 1, 1: 64, 2: 8, 3: 2}
SALTS = 16

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True
_SECOND = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts, the hashes of their windows and the pieces that windows must stay in."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        flat = Flat([text.translate(_LOWER) for text in texts])
        self.data, self.langs = flat.data, langs
        self.starts, self.ends = flat.runs(~_ENDS_WORD[flat.data])
        first = flat.first_of(self.starts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first))
        names, code = np.unique(langs, return_inverse=True)
        marks = np.array([int.from_bytes(blake2b(name.encode(), digest_size=8).digest()) for name in names.tolist()], dtype=np.uint64)
        self.words = flat.hashes(self.starts, self.ends) ^ marks[code][self.owner]
        piece = np.cumsum(_ENDS_PIECE[flat.data])[self.starts]
        self.joined = piece[1:] == piece[:-1]
        # Whether the space-joined words i and i + 1 stand in the text as they are.
        self.plain = (self.starts[1:] - self.ends[:-1] == 1) & (flat.data[self.ends[:-1]] == 0x20)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window at every word, whether it lies in one piece)."""
        found = window_hashes(self.words, size)
        inside = np.ones(found.size, dtype=bool)
        for k in range(size - 1):
            inside &= self.joined[k : k + found.size]
        return found, inside

    def phrases(self, at: np.ndarray, size: int) -> list[str]:
        """The windows' words, joined by one blank."""
        body = self.data.tobytes()
        whole = np.ones(at.size, dtype=bool)
        for k in range(size - 1):
            whole &= self.plain[at + k]
        out = [body[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist())]
        for k in np.flatnonzero(~whole).tolist():
            spans = range(int(at[k]), int(at[k]) + size)
            out[k] = b" ".join(body[self.starts[j] : self.ends[j]] for j in spans)
        return [phrase.decode() for phrase in out]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of consecutive texts of about ``CHUNK`` bytes in all."""
    held, langs, size = [], [], 0
    for batch in batches:
        for data, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
            held.append(data)
            langs.append(lang)
            size += len(data)
            if size >= CHUNK:
                yield Words(held, langs)
                held, langs, size = [], [], 0
    if held:
        yield Words(held, langs)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys in order, a place of each, how often it is there)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if keys.size else np.zeros(0, np.int64)
    return ordered[new], order[new], np.diff(np.append(new, keys.size))


_CELLS = "part long, cells binary, counts binary"


def _cells(part_bits: int, least: int):
    """Words and pairs by hash: a part of the hash's range, cells within it, counts up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _texts(batches):
            found = [hashes[inside] for hashes, inside in map(words.windows, (1, 2))]
            keys, _, counts = _counted(np.concatenate(found) >> np.uint64(64 - CELL_BITS - part_bits))
            part = (keys >> np.uint64(CELL_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if part.size else np.zeros(1, np.int64)
            cells, counts = keys.astype(np.uint32), np.minimum(counts, least).astype(np.uint16)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            columns = [part[cut[:-1]], [cells[a:b].tobytes() for a, b in spans], [counts[a:b].tobytes() for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if k == 0 else pa.array(c, pa.binary()) for k, c in enumerate(columns)], ["part", "cells", "counts"])

    return run


def _frequent(least: int):
    """Rows sorted by part: the hashes that were found ``least`` times, one part at a time."""

    def out(part: int, cells: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(cells)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), new)
        kept = keys[new[total >= least]].astype(np.int64) | (part << CELL_BITS)
        return pa.RecordBatch.from_arrays([pa.array(kept)], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, counts = None, [], []
        for batch in batches:
            for part, held, found in zip(batch.column("part").to_pylist(), batch.column("cells"), batch.column("counts")):
                if part != now and cells:
                    yield out(now, cells, counts)
                    cells, counts = [], []
                now = part
                cells.append(np.frombuffer(held.as_py(), np.uint32))
                counts.append(np.frombuffer(found.as_py(), np.uint16))
        if cells:
            yield out(now, cells, counts)

    return run


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """A key's two places in a filter of 2^bits bits."""
    yield (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    yield (mix(keys * _SECOND) >> np.uint64(64 - bits)).astype(np.int64)


class Frequent:
    """Bloom filter of the frequent words and pairs, by the upper bits of their hashes."""

    def __init__(self, key_bits: int, bits: int, filled: np.ndarray) -> None:
        self.key_bits, self.bits, self.filled = key_bits, bits, filled

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        keys = hashes >> np.uint64(64 - self.key_bits)
        found = np.ones(keys.size, dtype=bool)
        for place in _places(keys, self.bits):
            found &= (self.filled[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found


def part_bits(spark: SparkSession) -> int:
    """Parts that keys are dealt to, as a power of two: several for each task of a shuffle."""
    return min(20, max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def frequent_filter(texts: DataFrame, least: int) -> Frequent:
    """Filter that holds every word and pair of ``least`` or more occurrences in a language."""
    upper = part_bits(texts.sparkSession)
    sent = texts.mapInArrow(_cells(upper, least), _CELLS)
    keys = checkpointed(sent.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(least), "key long"))
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(16 * keys.count() + 1))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column("key").to_numpy().view(np.uint64)
            place = np.unique(np.concatenate(list(_places(hashed, bits))))
            if place.size:
                word = place >> 6
                new = np.flatnonzero(np.diff(word, prepend=-1))
                held = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), new)
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(held.view(np.int64))], ["word", "held"])

    # At most 2^FILTER_BITS / 64 rows, two million, whatever the input.
    rows = keys.mapInArrow(fill, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    filled = np.zeros(1 << (bits - 6), dtype=np.uint64)
    filled[rows.column("word").to_numpy()] = rows.column("held").to_numpy().view(np.uint64)
    return Frequent(upper + CELL_BITS, bits, filled)


_PACKED = "part long, body binary"
_NAMES = ["key", "total", "nexts", "counts"]
_STRIPE = "lang string, prefix string, total long, nexts array<string>, counts array<long>"


def _columns(words: Words, at: np.ndarray, keys: list[str], totals: np.ndarray, ends: np.ndarray, nexts: list[str], counts: np.ndarray) -> pa.Table:
    """Stripes as a table; a key is a prefix, a line feed, which no prefix holds, and the language."""
    langs = [words.langs[k] for k in words.owner[at].tolist()]
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (pa.array(nexts, pa.string()), counts.astype(np.int64))]
    return pa.table([pa.array([f"{key}\n{lang}" for key, lang in zip(keys, langs)], pa.string()), pa.array(totals.astype(np.int64)), *lists], names=_NAMES)


def _stripes(words: Words, known: Frequent, longest: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The stripes of a chunk by prefix length, with a hash that deals them out.

    A prefix's total stands in the first of its slots, the others say zero.
    """
    none = np.zeros(0, dtype=np.int64)
    langs, first, count = np.unique(np.array(words.langs)[words.owner], return_index=True, return_counts=True)
    yield _columns(words, first, [""] * first.size, count, np.zeros(first.size, np.int64), [], none), np.zeros(first.size, np.uint64)
    hashes, inside = words.windows(1)
    passed = known.may_hold(hashes)
    for size in range(1, longest):
        longer, inside = words.windows(size + 1)
        goes_on = inside & passed[: longer.size] & passed[1 : longer.size + 1]
        if size == 1:
            goes_on &= known.may_hold(longer)
        starts = np.flatnonzero(passed)
        keys, place, total = _counted(hashes[starts])
        at = starts[place]
        more = np.flatnonzero(goes_on)
        _, place, counts = _counted(longer[more])
        first = more[place]
        owner = np.searchsorted(keys, hashes[first])
        slot = (mix(words.words[first + size]) & np.uint64(SLOTS[size] - 1)).astype(np.int64)
        order = np.lexsort((slot, owner))
        first, owner, slot, counts = first[order], owner[order], slot[order], counts[order]
        new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0))
        ends = np.append(new[1:], owner.size) if new.size else none
        alone = np.setdiff1d(np.arange(keys.size), owner)
        row = np.concatenate([owner[new], alone])
        leads = np.concatenate([np.diff(owner[new], prepend=-1) != 0, np.ones(alone.size, dtype=bool)])
        prefixes = words.phrases(at, size)
        table = _columns(
            words, at[row], [prefixes[k] for k in row.tolist()], np.where(leads, total[row], 0),
            np.concatenate([ends, np.full(alone.size, owner.size)]), words.phrases(first + size, 1), counts,
        )
        yield table, mix(keys[row] + np.concatenate([slot[new], np.zeros(alone.size, np.int64)]).astype(np.uint64))
        hashes, passed = longer, goes_on


def _packed(words: Words, known: Frequent, longest: int, part_bits: int) -> pa.RecordBatch:
    """The stripes of a chunk, those of each part as one compressed body."""
    tables, dealt = zip(*_stripes(words, known, longest))
    table, part = pa.concat_tables(tables), (np.concatenate(dealt) >> np.uint64(64 - part_bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    table, part = table.take(pa.array(order)).combine_chunks(), part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if part.size else np.zeros(1, np.int64)
    bodies = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(a, b - a))
        bodies.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(bodies, pa.binary())], ["part", "body"])


def merged(table: pa.Table, least: int = 0) -> pa.Table:
    """Stripes of equal keys, added up element by element."""
    codes = table.column("key").combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    code, keys = codes.indices.to_numpy(), codes.dictionary
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, code, table.column("total").to_numpy())
    lengths = pc.list_value_length(table.column("nexts")).to_numpy()
    pairs = pa.table({"key": np.repeat(code, lengths), "next": pc.list_flatten(table.column("nexts")), "n": pc.list_flatten(table.column("counts"))})
    pairs = pairs.group_by(["key", "next"], use_threads=False).aggregate([("n", "sum")])
    pairs = pairs.filter(pc.greater_equal(pairs.column("n_sum"), least)).sort_by("key")
    offsets = pa.array(np.searchsorted(pairs.column("key").to_numpy(), np.arange(len(keys) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, _whole(pairs.column(name))) for name in ("next", "n_sum")]
    return pa.table([keys, pa.array(total), *lists], names=_NAMES)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _merge(least: int):
    """Rows sorted by part: its merged stripes; next words of fewer than ``least`` occurrences are left out."""

    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = merged(pa.concat_tables(held), least)
        named = [key.split("\n", 1) for key in table.column("key").to_pylist()]
        names = [pa.array([name[k] for name in named], pa.string()) for k in (1, 0)]
        columns = [*names, *[table.column(name) for name in _NAMES[1:]]]
        yield from pa.table(columns, names=["lang", "prefix", *_NAMES[1:]]).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body")):
                if part != now and held:
                    yield from out(held)
                    held, size = [], 0
                now = part
                held.append(pa.ipc.open_stream(body.as_buffer()).read_all())
                size += held[-1].num_rows
                if size > max(MERGE_ROWS, 2 * held[0].num_rows):
                    held = [merged(pa.concat_tables(held))]
                    size = held[0].num_rows
        if held:
            yield from out(held)

    return run


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang, prefix, total, nexts, counts``: merged stripes with the next words found ``least`` times.

    A prefix has a row for each of its slots, whose totals and counters add up. The empty prefix has the
    number of words of a language. Prefixes that the filter shows to be rarer than ``least`` are absent.
    """
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    spark, bits = docs.sparkSession, part_bits(docs.sparkSession)
    known = spark.sparkContext.broadcast(frequent_filter(texts, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _texts(batches):
            yield _packed(words, known.value, longest, bits)

    sent = texts.mapInArrow(run, _PACKED)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(least), _STRIPE)


def _cuts(words: Column, longest: int) -> Column:
    """Both parts of a phrase for every way to cut it in two."""
    join = lambda part: F.array_join(part, " ")
    length = F.size(words)
    every = []
    for k in range(1, longest):
        sides = [join(F.slice(words, 1, k)), join(F.slice(words, F.lit(k + 1), F.greatest(length - k, F.lit(0))))]
        every += [F.when(length > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))) for side, part in enumerate(sides)]
    return F.array_compact(F.array(*every))


def _score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts) in whole numbers of 38 digits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(19,0)"), parts.cast("decimal(20,0)"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, best: int = BEST,
    subsumed: int = SUBSUMED, longest: int = LONGEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to ``longest`` words of each language.

    A phrase found ``a`` times scores by its weakest cut into parts found ``l`` and ``r`` times. It goes if
    a longer candidate that holds it is found ``subsumed`` percent as often.
    """
    if longest > LONGEST:
        raise ValueError(f"prefixes have up to {LONGEST - 1} words")
    made = checkpointed(stripes(docs, text, lang, least, longest))
    totals = made.groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("total").alias("found"))
    words_of = totals.filter("part = ''").select("lang", F.col("found").alias("n"))
    grown = made.filter(F.size("nexts") > 0).select("lang", "prefix", F.inline(F.arrays_zip("nexts", "counts")))
    candidates = checkpointed(grown.select("lang", F.concat_ws(" ", "prefix", "nexts").alias("phrase"), F.col("counts").alias("a")))
    # Single words are parts of very many phrases: their totals are dealt out over SALTS keys.
    is_word = ~F.contains(F.col("part"), F.lit(" "))
    salts = F.when(is_word, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    totals = totals.filter(f"part <> '' AND found >= {least}").withColumn("salt", F.explode(salts))
    parts = candidates.select("lang", "phrase", "a", F.inline(_cuts(F.split("phrase", " "), longest)))
    parts = parts.withColumn("salt", F.when(is_word, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int"))
    sized = parts.join(totals, ["lang", "part", "salt"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("found")))
    cut = sized.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), *[side(k, s).alias(f"{name}{k}") for k in range(1, longest) for s, name in enumerate("lr")]
    )
    ways = [
        F.struct(_score(F.col("a"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        for k in range(1, longest)
    ]
    weakest = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"r{k}").isNotNull(), way) for k, way in zip(range(1, longest), ways)])))
    scored = cut.withColumn("way", weakest).select("lang", "phrase", "a", "way.l", "way.r", "way.score")
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, start, F.size(words) - 1), " ") for start in (1, 2)])
    longer = candidates.filter(F.size(words) > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("above"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * subsumed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(words_of, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
