"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, chat, codes, exact_dedup, license_scan, manifest, mixing, sharding, simhash, token_store, topk, toxicity, url_filter
from millrace.llm.common import shared_dir, table

#: One round of op12 in SQL: every part's nearest entry of codebook b{k}, and the codebook that follows from it.
ROUND = """
        a{k} AS (SELECT p.rid, p.part, p.x, min(struct_pack(d := (list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT, e := b.entry)) AS n
                 FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL),
        m{k} AS (SELECT part, entry, list(floor(s / c) ORDER BY pos) AS x FROM (
                     SELECT part, n.e AS entry, pos, sum(x[pos + 1]) AS s, count(*) AS c FROM a{k}, range(0, (SELECT w // 16 FROM n)) r(pos) GROUP BY ALL) GROUP BY ALL),
        b{up} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 that page_id decides.

    The list names a third of all patterns in the pages: each is blocked on some day, lifted 60 days later and
    blocked again after 90 more; one in five of them is allowed 20 days after it was blocked.
    """
    start = F.to_date(F.lit("2024-01-01"))
    day = lambda n: F.date_add(start, n.cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day(F.coalesce(F.pmod(F.col("page_id") * 37, F.lit(366)), F.lit(0))).alias("fetched"))
    names = captures.select(F.explode(url_filter.patterns(F.col("url"))).alias("pattern")).distinct()
    names = names.withColumn("h", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 6), 16, 10).cast("long")).filter("h % 3 = 0")
    first = F.col("h") % 200
    event = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("dated"))
    events = F.array(event("block", first), event("remove", first + 60), event("block", first + 150))
    events = F.when(F.col("h") % 15 == 0, F.array_append(events, event("allow", first + 20))).otherwise(events)
    entries = names.select("pattern", F.explode(events).alias("e")).select("pattern", "e.action", "e.dated")
    found = url_filter.evaluate(captures, entries)
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), Path(path).read_bytes(), pattern)


def op10_token_store(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return token_store.store_and_check(table(spark, sf_dir, "documents"), Path(path), 1, shared_dir(spark))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts look like marks of templates."""
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat.format_and_read(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.tampered_text())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_url_filter": op8_url_filter,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_store": op10_token_store,
    "op11_chat": op11_chat,
    "op12_vector_codes": op12_vector_codes,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op11_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, turn, role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        e AS (SELECT *, length('<turn >') + length('</turn>') + 1 + length(role) + length(text) + len(regexp_extract_all(role, '[\\<>]'))
                     + len(regexp_extract_all(text, '\\|</?turn|<image|<audio|<document')) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS attachments, 0::BIGINT AS tokens
        FROM e GROUP BY conv_id""",
    "op12_vector_codes": r"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        n AS (SELECT greatest(1, (coalesce(max(len(v)), 0) + 15) // 16) * 16 AS w FROM v),
        p AS (SELECT rid, part, list_resize(v, w, 0)[part * w // 16 + 1:(part + 1) * w // 16] AS x FROM v, n, range(0, 16) r(part)),
        b0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 64),""" + ROUND.format(k=0, up=1) + ROUND.format(k=1, up=2) + ROUND.format(k=2, up=3) + r"""
        f AS (SELECT rid, string_agg(lpad(lower(hex(n.e)), 2, '0'), '' ORDER BY part) AS code, sum(n.d)::BIGINT AS error FROM a2 GROUP BY rid)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(array_to_string(list_transform(flatten(list(x ORDER BY part, entry)), lambda c: c::BIGINT), ',')) FROM b2) AS codebooks_sha256
        FROM f JOIN v USING (rid)""",
    "op13_manifest": r"""
        WITH RECURSIVE f AS (
            SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS bare FROM documents),
        l AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS other,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || coalesce(strlen(text) || ':' || text, '-'))) - 1 AS pos FROM f),
        t(source, level, nodes) AS (
            SELECT source, 0, list(leaf ORDER BY pos) FROM l GROUP BY source
            UNION ALL SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM t WHERE len(nodes) > 1),
        s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
        u(level, nodes) AS (
            SELECT 0, list(subroot ORDER BY place) FROM s
            UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM u WHERE len(nodes) > 1),
        a AS (SELECT l.doc_id, l.source, l.pos, t.level, t.nodes, (l.pos // (3 ** t.level)::BIGINT) AS k FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1),
        b AS (SELECT s.source, u.level, u.nodes, (s.place // (3 ** u.level)::BIGINT) AS k FROM s, u WHERE len(u.nodes) > 1),
        lower_ AS (SELECT source, pos, list(array_to_string(nodes[k - k % 3 + 1:k], '') || '|' || array_to_string(nodes[k + 2:k - k % 3 + 3], '') ORDER BY level) AS path FROM a GROUP BY source, pos),
        upper_ AS (SELECT source, list(array_to_string(nodes[k - k % 3 + 1:k], '') || '|' || array_to_string(nodes[k + 2:k - k % 3 + 3], '') ORDER BY level) AS path FROM b GROUP BY source),
        p AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, list_concat(coalesce(w.path, []), coalesce(x.path, [])) AS path,
                     CASE WHEN register & 1 = 1 THEN l.other ELSE l.leaf END AS now  -- the CRC-32 is the register's complement
              FROM (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT + 1, 1))::BIGINT)),
                       lambda c, x: list_reduce(list_prepend(xor(c, x), range(0, 8)), lambda v, k: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS register FROM l) l
              JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN lower_ w ON l.source IS NOT DISTINCT FROM w.source AND l.pos = w.pos LEFT JOIN upper_ x ON l.source IS NOT DISTINCT FROM x.source)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
               list_reduce(list_prepend(now, path), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root,
               list_reduce(list_prepend(now, path), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) = root AS verified
        FROM p""",
    "op8_url_filter": r"""
        WITH c AS (SELECT row_number() OVER () AS row, page_id, url, (DATE '2024-01-01' + coalesce(((page_id * 37) % 366 + 366) % 366, 0)::INT) AS fetched,
                          regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '\.$', '') AS host,
                          regexp_extract(lower(coalesce(url, '')), '^[^:/?#]*://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
        p AS (SELECT *, CASE WHEN host = '' THEN [] ELSE list_concat(
                  list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                  CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) END AS names FROM c),
        n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT unnest(names) AS pattern FROM p)),
        e AS (SELECT pattern, a.action, (DATE '2024-01-01' + a.day::INT) AS dated FROM (
                  SELECT pattern, unnest([{'action': 'block', 'day': h % 200}, {'action': 'remove', 'day': h % 200 + 60}, {'action': 'block', 'day': h % 200 + 150}]) AS a FROM n WHERE h % 3 = 0
                  UNION ALL SELECT pattern, {'action': 'allow', 'day': h % 200 + 20} FROM n WHERE h % 15 = 0)),
        s AS (SELECT pattern, action, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS until FROM e),
        m AS (SELECT p.row, s.pattern, s.action, s.since, row_number() OVER (PARTITION BY p.row ORDER BY length(s.pattern) DESC, s.pattern DESC) AS nth, count(*) OVER (PARTITION BY p.row) AS n
              FROM (SELECT row, fetched, unnest(list_distinct(names)) AS name FROM p) p JOIN s ON p.name = s.pattern AND s.action <> 'remove' AND p.fetched >= s.since AND (s.until IS NULL OR p.fetched < s.until))
        SELECT page_id, url, fetched::VARCHAR AS fetched, host, coalesce(n, 0) AS n_active, pattern AS rule, action, since::VARCHAR AS since, coalesce(action = 'block', false) AS blocked
        FROM p LEFT JOIN m ON p.row = m.row AND nth = 1""",
    "op7_topk": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n""",
}
