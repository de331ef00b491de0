"""The registered text queries: each applies its operator to a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontam, html, langid, periodic, pii, warc
from .common import table
from .packing import pack
from .quality import quality
from .sharding import shards
from .simhash import near_duplicates
from .substring import substring_dedup


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), 40)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.formatted(chat.of_text(rows)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapsed(periodic.with_tails(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of_documents = (op1_sharding, op2_decontamination, op3_quality, op4_langid, op5_packing, op7_substring, op10_simhash, op11_pii, op12_filter_audit, op13_periodic_runs)
    return {f.__name__: f for f in (*of_documents, op6_html, op8_warc, op9_chat)}


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Windows by their words; a word goes if a window over it starts earlier elsewhere.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 18))) AS i FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(20) t(j) WHERE nth > 1),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT x.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

#: Base32 takes a SHA-1's hexadecimal digits by fives: twenty bits are four letters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS least, sha1(html) AS h FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST(concat('0x', substr(h, 5 * i + 1, 5)) AS BIGINT)) AS fives FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM b"""

CONTROL_SQL = "|".join(re.escape(c) for c in (chat.TURN, chat.BODY, chat.END, *chat.PLACEHOLDERS.values(), *chat.FOREIGN))
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(role) + length(regexp_replace(text, '({CONTROL_SQL})', '.\\1', 'g')) + {len(chat.TURN + chat.BODY + chat.END) + 1} AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn) AS every, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss, sum(chars) AS chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens FROM g"""


#: Which filters each document fails, and every order of them; a document is removed by the first filter that it fails.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
    CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda f: f IS NOT NULL) AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, array_to_string(list_sort(fails), '') AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) t(k)),
p AS (SELECT c.*, s.*, contains(fails, f) AS failing, before <> '' AND regexp_matches(fails, concat('[', CASE WHEN before = '' THEN '_' ELSE before END, ']')) AS earlier FROM c, s),
g AS (SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failing AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: no model, tokenizer, checksum or SimHash."""
    return {"op7_substring": OP7_SQL, "op8_warc": OP8_SQL, "op9_chat": OP9_SQL, "op12_filter_audit": OP12_SQL}
