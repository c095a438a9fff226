"""SpotSigs fingerprints: chains of content words behind common words, compared by pruned Jaccard.

A spot is a common word (``ANCHORS``); its signature is a hash of the spot and the next ``CHAIN`` content
words, common words between them left out. The set of a text's signatures is its fingerprint. A text without
a spot that has a chain gets one signature of the whole text, so that equal texts always have equal
fingerprints. Two sets are as alike as their Jaccard similarity.

``similar_classes`` finds all pairs at ``LEAST`` or more: equal sets count once; a set goes by its length
into partitions whose neighbours bound the length ratio, and by the rarest signatures of its prefix, of
which two similar sets must share one; candidates are compared in full. Nothing but DataFrame functions.

Defined results: a null text counts as empty; words are runs of letters and digits in lower case; rows of
equal ids follow each other in order of their texts; a null id comes first; a single row is followed by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.text import let
from fleetsight.session import checkpointed

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from has have in is it not of on or that the this to was were with"
    " au avec ce dans de des du en est et il la le les ne par pas pour que qui se sur un une"
    " auf das dem den der die ein eine es ich im ist mit nicht sich sie und von zu"
    " al con del el lo los las mi no por su sus y"
).split()
CHAIN = 2
LEAST = 0.8
HASH_DIGITS = 16
# Ids of a window over neighbouring documents, as a power of two; group numbers of the levels above.
GROUP_SHIFT = 10
LEVEL_SHIFT = 18


def _hash(value: Column) -> Column:
    return F.substring(F.md5(value.cast("binary")), 1, HASH_DIGITS)


def signatures(text: Column) -> Column:
    """The text's distinct signatures in order, never empty."""
    common = lambda word: word.isin(*ANCHORS)

    def chains(words: Column) -> Column:
        parts = F.struct(
            words.alias("all"),
            F.filter(words, lambda word: ~common(word)).alias("content"),
            F.filter(
                F.transform(words, lambda word, at: F.when(common(word), at)), lambda at: at.isNotNull()
            ).alias("spots"),
        )

        def chain(found: Column) -> Column:
            # Spot number k at place p has p - k content words before it.
            return F.transform(
                found["spots"],
                lambda p, k: F.when(
                    p - k + CHAIN <= F.size(found["content"]),
                    _hash(F.concat_ws(" ", F.get(found["all"], p), *[F.get(found["content"], p - k + j) for j in range(CHAIN)])),
                ),
            )

        return let(parts, chain)

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")
    spotted = F.array_sort(F.array_compact(F.array_distinct(let(words, chains))))
    return let(spotted, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(_hash(F.concat(F.lit("\0"), text)))))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(signature_set, " ")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(one, other))
    return let(shared, lambda n: n / (F.size(one) + F.size(other) - n))


def _next_groups(groups: DataFrame) -> DataFrame:
    """``g, next_g``: the next group number that there is; after the last comes the first.

    Two levels of coarser numbers, so that no window holds more than 2^18 numbers.
    """
    one = groups.withColumn("h", F.shiftright("g", LEVEL_SHIFT)).withColumn(
        "after", F.lead("g").over(Window.partitionBy("h").orderBy("g"))
    )
    two = groups.groupBy(F.shiftright("g", LEVEL_SHIFT).alias("h")).agg(F.min("g").alias("first_g"))
    two = two.withColumn("k", F.shiftright("h", LEVEL_SHIFT))
    three = two.groupBy("k").agg(F.min("first_g").alias("k_first"))
    order = Window.orderBy("k")  # at most 2^18 rows: numbers have 64 bits, of which 46 are shifted out
    three = three.select("k", F.coalesce(F.lead("k_first").over(order), F.min("k_first").over(order)).alias("after_k"))
    two = two.withColumn("after_h", F.lead("first_g").over(Window.partitionBy("k").orderBy("h"))).join(three, "k")
    two = two.select("h", F.coalesce("after_h", "after_k").alias("after_h"))
    return one.join(two, "h").select("g", F.coalesce("after", "after_h").alias("next_g"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, next_text``: each document beside the text of the next by id.

    Documents are sorted in groups of neighbouring ids; the last of a group is joined with the first of
    the next. All parts read one shuffle of the texts, so nothing is computed below it.
    """
    ids = F.col(doc_id).cast("long")
    group = F.coalesce(F.shiftright(ids, GROUP_SHIFT), F.lit(-(2**63))).alias("g")
    # Other names than the table's: equal names would be dropped in one part only, and the shuffle not shared.
    placed = docs.select(group, ids.alias("own_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("own_text"))
    order = Window.partitionBy("g").orderBy(F.col("own_id").asc_nulls_first(), "own_text")
    side = placed.select(
        "*",
        F.lead("own_text").over(order).alias("next_text"),
        F.lag(F.lit(1)).over(order).alias("has_previous"),
    )
    inner = side.filter("next_text IS NOT NULL").select("own_id", "own_text", "next_text")
    firsts = side.filter("has_previous IS NULL").select(F.col("g").alias("next_g"), F.col("own_text").alias("next_text"))
    lasts = side.filter("next_text IS NULL").select("g", "own_id", "own_text")
    following = _next_groups(docs.select(group).distinct())
    edge = lasts.join(following, "g").join(firsts, "next_g").select("own_id", "own_text", "next_text")
    return inner.unionByName(edge).select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), "next_text")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    In the edited text the last floor(n/2) characters are replaced by the first as many of the next document.
    """
    pairs = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    pairs = pairs.withColumn("edited", edited)
    found = pairs.withColumns({f"of_{name}": signatures(F.col(name)) for name in ("text", "edited", "next_text")})
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("of_text")).alias("fingerprint"),
        fingerprint(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("of_text"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("of_text"), F.col("of_next_text")).alias("near_next"),
    )


def similar_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST
) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, class_id`` for every row; ``a, b, likeness`` for classes at ``least`` or more, a < b).

    A class is one fingerprint; its id is a hash of it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marked = rows.select("doc_id", signatures(F.col("text")).alias("signatures"))
    marked = checkpointed(marked.withColumn("class_id", F.sha2(fingerprint(F.col("signatures")), 256)))
    classes = marked.groupBy("class_id").agg(F.any_value("signatures").alias("signatures"))
    classes = checkpointed(classes.withColumn("n", F.size("signatures")))
    # Lengths of similar sets differ by the factor 1 / least at most: they lie in one partition or in neighbours.
    lane = F.floor(F.log(F.col("n")) / math.log(1 / least) + 1e-9).cast("int")
    tokens = classes.select("class_id", "n", F.explode("signatures").alias("s"))
    common = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("found"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("found", "s"))
    prefix = tokens.join(common, "s").withColumn("at", rank).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    prefix = prefix.select("s", "class_id", "n", lane.alias("lane"))
    left = prefix.select("s", F.explode(F.array(F.col("lane"), F.col("lane") + 1)).alias("lane"), F.col("class_id").alias("a"), F.col("n").alias("n_a"))
    right = prefix.select("s", "lane", F.col("class_id").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("n_a") >= F.col("n_b") * least - 1e-9) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    candidates = left.join(right, ["s", "lane"]).filter(fits).select("a", "b").distinct()
    sets = lambda name: classes.select(F.col("class_id").alias(name), F.col("signatures").alias(f"{name}_set"))
    pairs = candidates.join(sets("a"), "a").join(sets("b"), "b")
    pairs = pairs.select("a", "b", likeness(F.col("a_set"), F.col("b_set")).alias("likeness")).filter(F.col("likeness") >= least)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return marked.select("doc_id", "class_id"), pairs
