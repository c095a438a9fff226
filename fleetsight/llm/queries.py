"""The operators' registered queries, each over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import (
    bpe, chat, collocations, cross_polytope, decontaminate, fill_middle, lm_scoring, quality, simhash, spotsigs, substring_dedup,
    url_filter, warc,
)

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.transform("mask", lambda span: F.concat_ws("-", span["begin"], span["end"]))
    return chat.rotate(table(spark, folder, "conversations")).withColumn("mask", F.array_join(spans, ","))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, url_filter.noisy_titles(pages)).select("page_id", "host", "path", "rule", "verdict")


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"), table(spark, folder, "conversations"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op11_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, folder, "embeddings"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.transform(table(spark, folder, "documents"))
    output, form = F.col("output"), F.col("form")
    found = fill_middle.parts(output, form)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length(found["prefix"]).cast("long").alias("prefix_chars"),
        F.length(found["middle"]).cast("long").alias("middle_chars"),
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(output, form).cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_classifier, op2_spotsigs, op3_decontamination, op4_warc, op5_chat_rotation, op6_url_filter,
        op7_lm_scoring, op8_bpe, op9_simhash, op10_substring_dedup, op11_cross_polytope,
        op12_collocations, op13_fill_middle,
    )
}

_ANCHORS = ", ".join(f"'{word}'" for word in spotsigs.ANCHORS)


def _signature_sql(text: str) -> str:
    """List of distinct signatures of the column ``text``, in order."""
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN len(found) > 0 THEN found ELSE [substr(md5(chr(0) || t), 1, 16)] END FROM (
        SELECT t, list_sort(list_distinct(list_filter(list_transform(spots, lambda p, k:
            CASE WHEN p - k + 2 <= len(content) THEN substr(md5(words[p] || ' ' || content[p - k + 1] || ' ' || content[p - k + 2]), 1, 16) END),
            lambda s: s IS NOT NULL))) AS found
        FROM (SELECT t, words, list_filter(words, lambda w: NOT list_contains(common, w)) AS content,
                     list_filter(list_transform(words, lambda w, i: CASE WHEN list_contains(common, w) THEN i END), lambda i: i IS NOT NULL) AS spots
              FROM (SELECT {text} AS t, {words} AS words, [{_ANCHORS}] AS common))))"""


def _jaccard_sql(one: str, other: str) -> str:
    shared = f"len(list_intersect({one}, {other}))"
    return f"{shared}::DOUBLE / (len({one}) + len({other}) - {shared})"


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANONICAL = r"CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '') END"

SQL: dict[str, str] = {
    "op2_spotsigs": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        following AS (SELECT doc_id, text, length(text) AS n_chars,
            coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM docs),
        edits AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM following),
        found AS (SELECT *, {_signature_sql("text")} AS own, {_signature_sql("edited")} AS changed, {_signature_sql("next_text")} AS others FROM edits)
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, ' ') AS fingerprint,
               array_to_string(changed, ' ') AS edited_fingerprint, {_jaccard_sql("own", "changed")} AS near_edited,
               {_jaccard_sql("own", "others")} AS near_next
        FROM found""",
    "op4_warc": """
        WITH parts AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed FROM pages),
        digests AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + ((('0x' || substr(hexed, 1 + 10 * (k // 8)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31))::INT, 1)), '') AS payload_digest
            FROM parts),
        owners AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM digests)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN owner <> page_id THEN owner END AS refers_to
        FROM owners""",
    "op5_chat_rotation": """
        WITH turns AS (SELECT conv_id, turn, floor(turn / 64)::BIGINT AS block, coalesce(nullif(trim(role), ''), 'unknown') AS role,
                              coalesce(text, '') AS text FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
        heads AS (SELECT conv_id, block, turn, role, text, speaker, role = speaker AS own,
                         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                                                ELSE 'user name=' || role END || chr(10) AS head
                  FROM turns JOIN speakers USING (conv_id)),
        placed AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS part,
                          sum(length(head || text) + 11) OVER (PARTITION BY conv_id, speaker, block ORDER BY turn, role, text
                                                               ROWS UNBOUNDED PRECEDING) AS upto FROM heads)
        SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(part, '' ORDER BY turn, role, text) AS text,
               coalesce(string_agg((upto - length(part) + length(head))::BIGINT || '-' || (upto - 1)::BIGINT, ',' ORDER BY turn, role, text)
                        FILTER (WHERE own), '') AS mask
        FROM placed GROUP BY conv_id, speaker, block""",
    "op6_url_filter": rf"""
        WITH parts AS (SELECT page_id, html, {_HOST} AS host,
                              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        keyed AS (SELECT *, {_CANONICAL} AS canonical,
                         '.' || host AS dotted FROM parts),
        listed AS (SELECT DISTINCT canonical FROM keyed
                   WHERE canonical <> '' AND regexp_matches(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1), '[%*$#&]{{3}}')),
        ruled AS (SELECT *, CASE WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                                 WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                                 WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                                 WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                                 WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM keyed)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op12_collocations": r"""
        WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
        sized AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS size FROM placed),
        counts AS (SELECT lang, w[i:i + size - 1] AS words, count(*) AS f FROM sized WHERE i + size - 1 <= len(w) GROUP BY ALL),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
        candidates AS (SELECT lang, words, f AS a FROM counts WHERE len(words) > 1 AND f >= 30),
        cuts AS (SELECT c.lang, c.words, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
                 FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates) c
                 JOIN counts l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN counts r ON r.lang = c.lang AND r.words = c.words[k + 1:]),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
        inner_parts AS (SELECT lang, a, words, unnest(range(1, len(words) + 1)) AS i FROM candidates),
        inner_spans AS (SELECT lang, a, words, i, unnest(range(1, len(words))) AS size FROM inner_parts),
        above AS (SELECT lang, words[i:i + size - 1] AS words, max(a) AS above FROM inner_spans WHERE i + size - 1 <= len(words) GROUP BY ALL),
        kept AS (SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM weakest w LEFT JOIN above b ON b.lang = w.lang AND b.words = w.words
                 WHERE b.above IS NULL OR 100 * b.above < 80 * w.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op13_fill_middle": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
        cut AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                       list_transform(range(4), lambda k: ('0x' || substr(digest, (1 + 8 * k)::INT, 8))::BIGINT) AS h FROM docs),
        chosen AS (SELECT *, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                               WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
        parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM chosen)
        SELECT doc_id, len(units)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
}
