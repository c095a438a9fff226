"""Inverted tables behind text search: words and three-character grams to ids.

A postings row says which rows of a block hold a term in a field; its ids are packed as steps from one to the
next. Blocks are cut where the rows lie, up to ``BLOCK_ROWS`` rows or ``BLOCK_CHARS`` characters each, so what
is shuffled and stored is about a byte per id and next to nothing for a term that all rows have. Rows lie in a
folder per bucket of the term's hash, in order of terms, so that a search reads the buckets of its own terms
only, and within these the row groups that can hold them. A term of very many rows is written by ``SLOTS``
tasks and read in parallel, as its blocks lie in several files. Batches are added as rows arrive; a batch that
is written again replaces itself.

Postings give candidates, and the exact test of :mod:`fleetsight.operators.search` decides among them. So rows
that changed need no removal here: what an old posting brings too much, the test throws out. A text that
holds a needle holds all of its grams, so no match is lost; needles of fewer than three characters have no
gram and scan.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.text import let
from fleetsight.operators import search as S
from fleetsight.session import prepare

GRAM = 3
BUCKETS = 16
SLOTS = 2
BLOCK_ROWS = 1 << 16
BLOCK_CHARS = 1 << 22
PIECES = 4
WORD_KIND, GRAM_KIND = "word", "gram"


def grams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case."""

    def cut(chars: Column) -> Column:
        first = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (GRAM - 1), F.lit(0)))
        return F.array_distinct(F.transform(first, lambda c, at: F.concat(c, F.get(chars, at + 1), F.get(chars, at + 2))))

    return let(F.split(F.lower(text), ""), cut)


def words(text: Column) -> Column:
    return F.array_distinct(S.tokens(text))


_TERMS = {WORD_KIND: words, GRAM_KIND: grams}


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# --- packed ids -------------------------------------------------------------------
_WIDTHS = ("<u1", "<u2", "<u4", "<u8")
_SHORT = 64


def pack_all(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Runs of ascending 64-bit ids, each from its start to the next: the first, the width of the steps, the steps.

    An id that a run repeats is packed once. Steps and widths of all runs are found at once, as most runs are short.
    """
    first = np.ones(ids.size, dtype=bool)
    first[1:] = ids[1:] != ids[:-1]
    first[starts] = True
    if not first.all():
        ids, starts = ids[first], (np.cumsum(first) - 1)[starts]
    ends = np.append(starts[1:], ids.size) - 1
    steps = np.zeros(ids.size, dtype=np.uint64)
    steps[:-1] = np.diff(ids).view(np.uint64)
    steps[ends] = 0
    most = np.maximum.reduceat(steps, starts)
    widths = (most >= 1 << 8).astype(np.uint8) + (most >= 1 << 16) + (most >= 1 << 32)
    bodies = {width: steps.astype(_WIDTHS[width]).tobytes() for width in np.unique(widths).tolist()}
    heads, marks = ids[starts].tobytes(), [bytes([width]) for width in range(8)]
    out = []
    for at, (a, b, width) in enumerate(zip(starts.tolist(), ends.tolist(), widths.tolist())):
        body = bodies[width][a << width : b << width]
        if len(body) > _SHORT:
            width, body = width + 4, zlib.compress(body, 1)
        out.append(heads[8 * at : 8 * at + 8] + marks[width] + body)
    return out


def pack(ids: np.ndarray) -> bytes:
    return bytes(1) if not ids.size else pack_all(ids, np.zeros(1, dtype=np.int64))[0]


def unpack(packed: bytes) -> np.ndarray:
    body = zlib.decompress(packed[9:]) if packed[8] > 3 else packed[9:]
    ids = np.empty(1 + len(body) // (1 << packed[8] % 4), dtype=np.int64)
    ids[0] = np.frombuffer(packed, "<i8", 1)[0]
    ids[1:] = np.frombuffer(body, _WIDTHS[packed[8] % 4]).astype(np.uint64).view(np.int64)
    return np.cumsum(ids)


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _layout(id_type: T.DataType) -> T.StructType:
    """Integer ids are packed; ids of other types, and null, stand in ``ids``."""
    return T.StructType().add("kind", "string").add("field", "string").add("term", "string").add("block", "long").add(
        "piece", "integer").add("n", "integer").add("packed", "binary").add("ids", T.ArrayType(id_type))


def _cells(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Bytes of each text, and all of them in a row; a null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    return np.diff(ends), memoryview(data if data is not None else b"")[ends[0] : ends[-1]]


def _gram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, code) of each gram, rows in order; the gram of each code."""
    sizes, data = _cells(texts)
    chars = np.frombuffer(data, dtype=np.uint8)
    plain = not chars.size or chars.max() < 128
    if not plain:
        chars = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    whole = owner[2:] == owner[:-2]
    bits = 7 if plain else 21
    keys = chars.astype(np.int32 if plain else np.int64)
    keys = (keys[:-2] | keys[1:-1] << bits | keys[2:] << 2 * bits)[whole]
    if plain:
        seen = np.zeros(1 << 3 * bits, dtype=bool)
        seen[keys] = True
        named = np.flatnonzero(seen)
        codes = np.zeros(1 << 3 * bits, dtype=np.int32)
        codes[named] = np.arange(named.size, dtype=np.int32)
        codes, named = codes[keys], named.tolist()
    else:
        found = pa.array(keys).dictionary_encode()
        codes, named = found.indices.to_numpy(), found.dictionary.to_pylist()
    mask = (1 << bits) - 1
    return owner[:-2][whole], codes, ["".join(chr(key >> at & mask) for at in (0, bits, 2 * bits)) for key in named]


def _word_codes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(sizes.size, dtype=np.int32), sizes), found.indices.to_numpy(), found.dictionary.to_pylist()


def _block(rows: pa.Table, columns: list[tuple[str, str, str]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The postings of a block of rows, in ``PIECES`` runs of neighbouring ids."""
    ids = rows.column("id").combine_chunks()
    if pa.types.is_integer(ids.type) and not ids.null_count:
        values = ids.to_numpy().astype(np.int64)
        order = np.argsort(values, kind="stable")
        rows, values = rows.take(pa.array(order)), values[order]
        name = values.tobytes()
    else:
        values, name = ids.to_pylist(), repr(ids.to_pylist()).encode()
    block = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
    for column, kind, field in columns:
        cells = rows.column(column).combine_chunks()
        owner, code, terms = _gram_codes(cells) if kind == GRAM_KIND else _word_codes(cells)
        if not terms:
            continue
        order = np.argsort(code.astype(np.uint16) if len(terms) <= 1 << 16 else code, kind="stable")
        owner, code = owner[order], code[order]
        new = np.ones(owner.size, dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        owner, code = owner[new], code[new]
        piece = (np.arange(rows.num_rows) * PIECES // rows.num_rows).astype(np.int32)[owner]
        starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])]))
        ends = np.append(starts[1:], owner.size)
        n, whole = starts.size, isinstance(values, np.ndarray)
        plain = [[values[k] for k in owner[a:b].tolist()] for a, b in zip(starts.tolist(), ends.tolist())] if not whole else None
        made = {
            "kind": pa.repeat(pa.scalar(kind), n), "field": pa.repeat(pa.scalar(field), n),
            "term": pa.array(terms, pa.string()).take(pa.array(code[starts])), "block": pa.repeat(pa.scalar(block), n),
            "piece": pa.array(piece[starts]), "n": pa.array((ends - starts).astype(np.int32)),
            "packed": pack_all(values[owner], starts) if whole else [None] * n, "ids": plain or pa.nulls(n, schema.field("ids").type),
        }
        columns_ = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, made[f.name]) for f in schema)]
        yield from pa.table(columns_, schema=schema).to_batches(1 << 12)


def _blocks(columns: list[tuple[str, str, str]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, chars = [], 0, 0
        for batch in batches:
            ends, start = np.cumsum(batch.column("chars").to_numpy()), 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                fits = int(np.searchsorted(ends, before + BLOCK_CHARS - chars, side="right")) - start
                take = min(batch.num_rows - start, BLOCK_ROWS - rows, fits if rows else max(fits, 1))
                if take:
                    held.append(batch.slice(start, take))
                    rows, chars, start = rows + take, chars + int(ends[start + take - 1]) - before, start + take
                if start < batch.num_rows:
                    yield from _block(pa.Table.from_batches(held), columns, schema)
                    held, rows, chars = [], 0, 0
        if rows:
            yield from _block(pa.Table.from_batches(held), columns, schema)

    return run


def postings(rows: DataFrame, id_column: str, fields: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """``kind, field, term, block, piece, n, packed, ids``: which rows of a piece of a block have a term in a field.

    ``fields`` has texts by kind and field name. A null text has no terms.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, cells, chars = [], [], F.lit(0).cast("long")
    for kind, named in fields.items():
        for name, text in named.items():
            columns.append((f"c{len(columns)}", kind, name))
            cells.append((F.lower(text) if kind == GRAM_KIND else S.tokens(text)).alias(columns[-1][0]))
            chars = chars + F.coalesce(F.length(text), F.lit(0))
    layout = _layout(rows.schema[id_column].dataType)
    run = _blocks(columns, to_arrow_schema(layout))
    return rows.select(F.col(id_column).alias("id"), chars.alias("chars"), *cells).mapInArrow(run, layout)


def add_batch(found: DataFrame, folder: str, batch: str, buckets: int = BUCKETS, slots: int = SLOTS) -> None:
    """Write the postings of a batch, laid out by bucket and ordered by term."""
    slot = F.pmod(F.col("piece") + PIECES * F.pmod(F.xxhash64("block"), F.lit(1 << 20)), F.lit(slots))
    placed = found.withColumns({"bucket": bucket_of(F.col("term"), buckets), "slot": slot})
    order = ("bucket", "kind", "term", "field", "block", "piece")
    dealt = placed.repartition(buckets * slots, "bucket", "slot").sortWithinPartitions(*order).drop("slot")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/batch={batch}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.option("basePath", folder).parquet(folder)


def _id_type(table: DataFrame) -> T.DataType:
    return table.schema["ids"].dataType.elementType


def _listed(lists: list[dict]) -> set | np.ndarray:
    """All ids of some postings."""
    if all(row["packed"] is not None for row in lists):
        found = [unpack(row["packed"]) for row in lists]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return {id_ for row in lists for id_ in (unpack(row["packed"]).tolist() if row["packed"] is not None else row["ids"])}


def flat(table: DataFrame) -> DataFrame:
    """Postings as rows: ``kind, field, term, block, piece, id``."""
    id_type = pa_type(_id_type(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = _listed([row])
                n, ids = len(held), pa.array(list(held) if isinstance(held, set) else held, id_type)
                named = [pa.array([row[name]] * n, batch.schema.field(name).type) for name in ("kind", "field", "term", "block", "piece")]
                yield pa.RecordBatch.from_arrays([*named, ids], ["kind", "field", "term", "block", "piece", "id"])

    layout = T.StructType([*_layout(_id_type(table)).fields[:5], T.StructField("id", _id_type(table))])
    return table.select("kind", "field", "term", "block", "piece", "packed", "ids").mapInArrow(run, layout)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def compact(spark: SparkSession, folder: str, into: str, buckets: int = BUCKETS, slots: int = SLOTS) -> None:
    """All batches as one in another folder, each posting once, in one of its blocks."""
    table = read(spark, folder)
    once = flat(table).groupBy("kind", "field", "term", "id").agg(F.min(F.struct("block", "piece")).alias("at"))
    lists = once.groupBy("kind", "field", "term", "at").agg(F.sort_array(F.collect_list(F.struct("id")))["id"].alias("ids"), F.count(F.lit(1)).cast("int").alias("n"), F.count("id").alias("known"))
    if isinstance(_id_type(table), _INTEGERS):
        packer = F.udf(lambda ids: pack(np.array(ids, dtype=np.int64)), "binary")
        full = F.col("n") == F.col("known")
        lists = lists.withColumns({"packed": F.when(full, packer(F.when(full, F.col("ids")).otherwise(F.array()))), "ids": F.when(~full, F.col("ids"))})
    else:
        lists = lists.withColumn("packed", F.lit(None).cast("binary"))
    add_batch(lists.select("kind", "field", "term", "at.block", "at.piece", "n", "packed", "ids"), into, "all", buckets, slots)


def _wanted(spark: SparkSession, kind: str, text: str, buckets: int) -> list[tuple[int, str]]:
    """(bucket, term) of a query; as few as the query is short."""
    terms = spark.range(1).select(F.explode(_TERMS[kind](F.lit(text))).alias("term"))
    return [tuple(row) for row in terms.select(bucket_of(F.col("term"), buckets), "term").collect()]


def _common(terms: int, id_type: pa.DataType) -> Callable:
    """The ids that all terms of a group list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in batch.column("lists"):
                by_term = {}
                for row in lists.as_py():
                    by_term.setdefault(row["term"], []).append(row)
                if len(by_term) < terms:
                    continue
                kept, *others = (_listed(rows) for rows in sorted(by_term.values(), key=lambda rows: sum(row["n"] for row in rows)))
                for more in others:
                    if isinstance(kept, np.ndarray) and isinstance(more, np.ndarray):
                        kept = np.intersect1d(kept, more, assume_unique=True)
                    else:
                        kept = set(kept if isinstance(kept, set) else kept.tolist()) & set(more if isinstance(more, set) else more.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(list(kept) if isinstance(kept, set) else kept, id_type)], ["id"])

    return run


def ids_with_all(table: DataFrame, kind: str, text: str, fields: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``id`` of rows of which one field holds all terms of the text.

    The buckets are constants of the plan, so others are not listed; terms are a filter of the scan. The lists
    of a piece of a block meet and are intersected, which takes no row per hit.
    """
    wanted = _wanted(table.sparkSession, kind, text, buckets)
    hits = table.filter(F.col("bucket").isin(*{bucket for bucket, _ in wanted}) & (F.col("kind") == kind))
    hits = hits.filter(F.col("term").isin(*[term for _, term in wanted]))
    if fields is not None:
        hits = hits.filter(F.col("field").isin(*fields))
    met = hits.groupBy("batch", "field", "block", "piece").agg(F.collect_list(F.struct("term", "n", "packed", "ids")).alias("lists"))
    met = met.filter(F.size("lists") >= len(wanted)).select("lists")
    id_type = _id_type(table)
    return met.mapInArrow(_common(len(wanted), pa_type(id_type)), T.StructType([T.StructField("id", id_type)])).distinct()


def has_gram(needle: str) -> bool:
    return len(needle) >= GRAM


# --- records and their links ----------------------------------------------------
def _joined(values: str) -> Column:
    return F.array_join(values, " ")


def record_text() -> Column:
    """What word search reads: all text columns and tags of a record."""
    return F.concat_ws(" ", *S.TEXT_COLUMNS, _joined("tags"))


def holds_words(text: Column, q: str, wanted: list[str]) -> Column:
    """Whether a text has all words of ``q``, which are ``wanted``. Only a text that holds each as characters is cut into words."""
    if not wanted:
        return F.lit(False)
    found = F.lit(True)
    for word in wanted:
        found = found & F.contains(F.lower(text), F.lit(word))
    return found & S.matches_tokens(words(text), q)


TEXT_FIELDS = (*S.TEXT_COLUMNS, "tags")
SOURCE_FIELDS = ("source_names", "source_urls", "canonical_source_url")
LINK_FIELDS = ("source_name", "source_url", "external_id")


def record_postings(records: DataFrame) -> DataFrame:
    gram_fields = {name: F.col(name) for name in (*S.TEXT_COLUMNS, "canonical_source_url")}
    gram_fields |= {name: _joined(name) for name in ("tags", "source_names", "source_urls")}
    return postings(records, "id", {WORD_KIND: {"text": record_text()}, GRAM_KIND: gram_fields})


def link_postings(links: DataFrame) -> DataFrame:
    """Postings of a record's links, under the record's id."""
    return postings(links, "threat_intelligence_id", {GRAM_KIND: {name: F.col(name) for name in LINK_FIELDS}})


def text_candidates(table: DataFrame, q: str, buckets: int = BUCKETS) -> DataFrame | None:
    """Ids that can match ``q`` in a text column or by its words; None if all rows have to be looked at."""
    if not has_gram(q.lower()):
        return None
    by_gram = ids_with_all(table, GRAM_KIND, q.lower(), list(TEXT_FIELDS), buckets)
    # Without words of its own a query matches none.
    has_words = bool(_wanted(table.sparkSession, WORD_KIND, q, buckets))
    return by_gram.unionByName(ids_with_all(table, WORD_KIND, q, buckets=buckets)).distinct() if has_words else by_gram


def search(records: DataFrame, links: DataFrame, table: DataFrame, of_links: DataFrame, params: S.SearchParams, buckets: int = BUCKETS) -> DataFrame:
    """Records that a search matches, words of ``q`` in any order included.

    ``table`` and ``of_links`` are the postings of the records and of their links. Each text condition
    first narrows the records to its candidates; conditions without a gram are left to the exact test.
    """
    found = records
    q, source = S._clean(params.q), S._clean(params.source)
    narrowed = [text_candidates(table, q, buckets)] if q else []
    for needle, field in ((params.vendor, "affected_vendor"), (params.product, "affected_product"), (params.tag, "tags")):
        if (needle := S._clean(needle)) and has_gram(needle.lower()):
            narrowed.append(ids_with_all(table, GRAM_KIND, needle.lower(), [field], buckets))
    linked = None
    if source and has_gram(source.lower()):
        linked = ids_with_all(of_links, GRAM_KIND, source.lower(), list(LINK_FIELDS), buckets)
        narrowed.append(ids_with_all(table, GRAM_KIND, source.lower(), list(SOURCE_FIELDS), buckets).unionByName(linked).distinct())
    for ids in narrowed:
        if ids is not None:
            found = found.join(ids, "id", "left_semi")
    exact = S.record_filter(S.SearchParams(**(vars(params) | {"q": None})))
    if q:
        exact = exact & (S.matches_text(q) | holds_words(record_text(), q, [term for _, term in _wanted(records.sparkSession, WORD_KIND, q, buckets)]))
    found = found.filter(exact)
    if source:
        near = links if linked is None else links.join(linked.withColumnRenamed("id", "threat_intelligence_id"), "threat_intelligence_id", "left_semi")
        found = S.filter_by_source(found, near, source)
    return found


def candidate_counts(records: DataFrame, links: DataFrame, table: DataFrame, of_links: DataFrame, queries: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``q, candidates, hits`` of each query string: how much the exact test had to throw out."""
    counts = []
    for q in queries:
        ids = text_candidates(table, q, buckets)
        ids = records.select("id") if ids is None else ids
        hits = search(records, links, table, of_links, S.SearchParams(q=q), buckets).select("id", F.lit(True).alias("hit"))
        counted = ids.join(hits, "id", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("hits"))
        counts.append(counted.select(F.lit(q).alias("q"), "candidates", "hits"))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


class SearchIndex:
    """Postings of records and links in a folder, fed batch by batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, slots: int = SLOTS) -> None:
        self.spark, self.folder, self.buckets, self.slots = spark, folder, buckets, slots

    def add(self, batch: str, records: DataFrame | None = None, links: DataFrame | None = None) -> None:
        for name, rows, made in (("records", records, record_postings), ("links", links, link_postings)):
            if rows is not None:
                add_batch(made(rows), f"{self.folder}/{name}", batch, self.buckets, self.slots)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        return read(self.spark, f"{self.folder}/records"), read(self.spark, f"{self.folder}/links")

    def search(self, records: DataFrame, links: DataFrame, params: S.SearchParams) -> DataFrame:
        return search(records, links, *self.tables(), params, self.buckets)

    def counts(self, records: DataFrame, links: DataFrame, queries: list[str]) -> DataFrame:
        return candidate_counts(records, links, *self.tables(), queries, self.buckets)
