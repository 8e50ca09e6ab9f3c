"""The registered queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.ann import op3_ann
from loamgraph.llm.brown import op8_brown
from loamgraph.llm.minhash import op2_minhash
from loamgraph.llm.packing import op10_packing
from loamgraph.llm.pieces import op7_sentencepiece
from loamgraph.llm.rpforest import op5_rpforest
from loamgraph.llm.secrets import op1_secrets
from loamgraph.llm.shards import op6_shards
from loamgraph.llm.toxicity import op4_toxicity
from loamgraph.llm.warc import op9_warc


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of ``op1_secrets``: the spans of the base patterns."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of all documents as ``op6_shards`` gives them."""
    return op6_shards(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard of ``op6_shards``: its rows, first and last slot, and how many slots there are."""
    slots = op6_shards(spark, sf_dir).groupBy("shard")
    return slots.agg(F.count("*").alias("rows"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))


def pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document came back whole from ``op7_sentencepiece``."""
    return op7_sentencepiece(spark, sf_dir).select("doc_id", "round_trip", "decoded_crc32")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of ``op8_brown``: all but the model's score."""
    return op8_brown(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the laws of ``op10_packing``: sequences over 1024 tokens or with gaps, documents whose pieces are not
    numbered from 0, leave gaps, or are cut although they fit or elsewhere than at full pieces from the end."""
    p = op10_packing(spark, sf_dir)
    sequences = p.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"))
    documents = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.min("start").alias("first"), F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_if((F.col("piece") > 0) & (F.col("length") != 1024)).alias("short"))
    overfull = sequences.agg(F.count_if(F.expr("n > 1024")).alias("overfull"), F.count_if(F.expr("first <> 0 or `end` <> n")).alias("gaps"))
    whole = documents.agg(F.count("*").alias("documents"), F.count_if(F.expr("last <> pieces - 1 or first <> 0 or `end` <> n or short > 0 or pieces <> ceil(n / 1024)")).alias("miscut"))
    return overfull.crossJoin(whole).select(*[F.col(c).cast("long").alias(c) for c in ("documents", "overfull", "gaps", "miscut")])  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_minhash": op2_minhash,
    "op3_ann": op3_ann,
    "op4_toxicity": op4_toxicity,
    "op5_rpforest": op5_rpforest,
    "op6_shards": op6_shards,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_brown": op8_brown,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "secrets_base": secrets_base,
    "shard_sizes": shard_sizes,
    "shard_laws": shard_laws,
    "pieces_round_trip": pieces_round_trip,
    "base_scores": base_scores,
    "packing_laws": packing_laws,
}

WARC_SQL = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), shared AS (
  SELECT payload_digest, min(page_id) AS first FROM own WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM own LEFT JOIN shared USING (payload_digest)
"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of the UTF-8 bytes of a text in SQL, from the table ``crc`` below."""
    code = f"[('0x' || h)::INT FOR h IN regexp_extract_all(hex(encode({text})), '..')]"
    return f"xor(list_reduce(list_prepend(4294967295, {code}::BIGINT[]), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


# the remainder of each byte, by eight steps
CRC = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]) + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def spans_sql(kind: str, order: int, pattern: str, least: int, group: int) -> str:
    """(doc_id, kind, k, s, e): the matches of a pattern, from the lengths of what stands between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS k, s, s + len(m) AS e FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest([list_sum([len(x) FOR x IN ps[:i]]) + coalesce(list_sum([len(x) FOR x IN ms[:i - 1]]), 0) FOR i IN range(1, len(ms) + 1)])::BIGINT AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE len(ms) > 0
    ) WHERE len(g) >= {least}"""


SECRETS_SQL = f"""
WITH spans AS ({spans_sql('assign', 0, ASSIGN, 8, 2)} UNION ALL {spans_sql('access', 1, 'AKIA[A-Z0-9]+', 16, 0)} UNION ALL {spans_sql('hex', 2, '[0-9a-f]+', 32, 0)})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
REACH = """pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT id, id AS r FROM ids UNION SELECT reach.id, pairs.y FROM reach JOIN pairs ON pairs.x = reach.r),
smallest AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

MINHASH_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ids AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN smallest ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

FOREST_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings), {REACH}
SELECT vec_id, (SELECT count(*) FROM pairs WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN smallest ON id = vec_id
"""

SHARD_SIZES_SQL = f"""
WITH {CRC} SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32, 'rows' AS law FROM documents, crc
"""

SHARD_LAWS_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(24))::INT AS shard),
r AS (SELECT shard, (shard + 1) * n // 24 - shard * n // 24 AS rows FROM s, n)
SELECT shard, rows, 0::BIGINT AS first, rows - 1 AS last, rows AS slots FROM r WHERE rows > 0
"""

ROUND_TRIP_SQL = f"""WITH {CRC} SELECT doc_id, true AS round_trip, {crc32_sql("coalesce(text, '')")} AS decoded_crc32 FROM documents, crc"""

BASE_SCORES_SQL = f"""
WITH {CRC}, w AS (SELECT doc_id, {WORDS} AS words, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held_out FROM documents, crc),
t AS (SELECT doc_id, held_out, unnest(list_append(words, ' ')) AS token FROM w),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3)::DOUBLE AS base_score
FROM t LEFT JOIN c USING (token), total GROUP BY doc_id, held_out, n, v
"""

PACKING_LAWS_SQL = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS miscut FROM documents"

ORACLES: dict[str, str] = {
    "op2_minhash": MINHASH_SQL,
    "op5_rpforest": FOREST_SQL,
    "op9_warc": WARC_SQL,
    "secrets_base": SECRETS_SQL,
    "shard_sizes": SHARD_SIZES_SQL,
    "shard_laws": SHARD_LAWS_SQL,
    "pieces_round_trip": ROUND_TRIP_SQL,
    "base_scores": BASE_SCORES_SQL,
    "packing_laws": PACKING_LAWS_SQL,
}
