"""The queries of the corpus operators, by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    byte_bpe,
    chat,
    language,
    mixing,
    ngram_join,
    quality_rules,
    repeated,
    runs,
    secrets,
    sharding,
    top_k,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, in itself and inside nested encodings."""
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text and the verdict of the learned decision list."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two thirds of the documents."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per assistant turn of every conversation, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], rows.schema)
    return chat.read_back(chat.expand(rows.unionByName(extra)))


# In SQL the digests come from the table itself: a whole round trip leaves it as it was.
CHECKS["op2_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), digests AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
         (count(*) FILTER (role = 'assistant' OR is_last)) AS n_examples
  FROM ordered GROUP BY conv_id
), formatted AS (
  SELECT conv_id, turn, role, text, is_last,
         sum(length(role) + length(text) + 12 + length(text) - length(replace(text, '\', ''))
             + (length(text) - length(replace(text, '<|', ' ')))
             + (length(text) - length(replace(text, '|>', ' ')))
             + (length(text) - length(replace(text, '<s>', '  ')))
             + (length(text) - length(replace(text, '</s>', '   ')))
             + (length(text) - length(replace(text, '[INST]', '     ')))
             + (length(text) - length(replace(text, '[/INST]', '      ')))
             + (length(text) - length(replace(text, '<<SYS>>', '      ')))
             + (length(text) - length(replace(text, '<</SYS>>', '       '))))
           OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars
  FROM ordered
)
SELECT d.*, f.formatted_chars
FROM digests d JOIN (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM formatted
  WHERE role = 'assistant' OR is_last GROUP BY conv_id) f USING (conv_id)
"""


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, similarity 0.8 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


CHECKS["op1_ngram_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))))
    WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM split
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), smallest AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, y) AS component_id FROM sets LEFT JOIN smallest ON x = doc_id
"""


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the 13-word windows that an earlier document has."""
    return repeated.remove_repeated(table(spark, sf_dir, "documents"))


CHECKS["op7_repeated_passages"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS pos, w FROM split WHERE len(w) >= 13
), hashed AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS first FROM hashed GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 12)) AS pos
  FROM hashed JOIN firsts USING (h) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM split
), kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (g.pos IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").where(top_k.usable("embedding"))
    points = vectors.select("vec_id", top_k.scaled("embedding").alias("point"))
    return top_k.top_k(points, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


CHECKS["op4_top_k"] = r"""
WITH points AS (
  SELECT vec_id, row_number() OVER () AS row, len(embedding) AS dim,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS point
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other,
         coalesce(list_sum(list_transform(list_zip(q.point, c.point), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM points q JOIN points c ON q.dim = c.dim AND q.row <> c.row WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, with the targets of the sources."""
    return mixing.report(table(spark, sf_dir, "documents"))


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), keep=("page_id",))


# One pass over entities: what stands between two of them is kept, and each is looked up by itself.
ENTITIES_SQL = """
    array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'),
      list_append(regexp_extract_all({text}, '{pattern}'), '')), lambda z: z[1] || CASE
        WHEN z[2] = '' OR z[2] IS NULL THEN ''
        WHEN z[2][2] <> '#' THEN coalesce(map_extract_value(names.t, z[2][2:-2]), z[2])
        WHEN number(z[2]) BETWEEN 1 AND 55295 OR number(z[2]) BETWEEN 57344 AND 1114111 THEN chr(number(z[2])::INTEGER)
        ELSE z[2] END), '')"""


def _entities_sql(text: str) -> str:
    number = "(CASE WHEN lower(z[2][3]) = 'x' THEN ('0x' || z[2][4:-2]) ELSE z[2][3:-2] END)::BIGINT"
    sql = ENTITIES_SQL.replace("{text}", text).replace("{pattern}", warc.ENTITY)
    return sql.replace("number(z[2])", number)


def _names_sql() -> str:
    names = warc.named_entities()
    quoted = [", ".join("'" + v.replace("'", "''") + "'" for v in side) for side in (names, names.values())]
    return f"SELECT map([{quoted[0]}], [{quoted[1]}]) AS t"


CHECKS["op8_warc_derivatives"] = r"""
WITH names AS (@names), pages_of AS (
  SELECT page_id, url AS target_uri, '1970-01-01T00:00:00Z' AS date, coalesce(html, '') AS body,
         sha256(concat_ws('|', 'response', page_id::VARCHAR, url)) AS k,
         'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || strlen(coalesce(html, '')) AS h2
  FROM pages
), stripped AS (
  SELECT *, chr(13) || chr(10) AS e,
    '<urn:uuid:' || k[1:8] || '-' || k[9:12] || '-' || k[13:16] || '-' || k[17:20] || '-' || k[21:32] || '>' AS refers_to,
    regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
        '<!--.*?(?:-->|\z)', '', 'gs'),
        '<script\b[^>]*>.*?(?:</script\s*>|\z)', '', 'gis'), '<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'gis'),
        '<template\b[^>]*>.*?(?:</template\s*>|\z)', '', 'gis'), '<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)', '', 'gis'),
      '</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)\b[^>]*>', chr(10), 'gi'),
      '<[a-zA-Z/!?][^>]*>', '', 'g') AS t,
    regexp_extract(body, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is') AS raw_title,
    list_transform(regexp_extract_all(body, '<a[\s/]+(?:[^\s=>"''/]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?[\s/]+)*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'i'),
      lambda v: trim(v, '"''')) AS links
  FROM pages_of
), decoded AS (
  SELECT stripped.*, @text AS t2, @title AS title2, list_transform(links, lambda v: @link) AS outlinks FROM stripped, names
), tidy AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(t2, '[ \t\r\f\x0B\xA0]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
    regexp_replace(regexp_replace(replace(title2, chr(10), ' '), '[ \t\r\f\x0B\xA0]+', ' ', 'g'), '^ +| +$', '', 'g') AS title,
    'sha256:' || sha256('HTTP/1.1 200 OK' || e || h1 || e || h2 || e || e || body) AS source_block_digest,
    'sha256:' || sha256(body) AS source_payload_digest
  FROM decoded
), blocks AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'software: faultline' || e || 'source-status: HTTP/1.1 200 OK' || e || 'source-header: ' || h1 || e || 'source-header: ' || h2 || e
    || 'source-block-digest: ' || source_block_digest || e || 'source-payload-digest: ' || source_payload_digest || e
    || 'title: ' || title || e
    || coalesce(array_to_string(list_transform(outlinks, lambda v: 'outlink: ' || v || e), ''), '') AS block
  FROM tidy
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM tidy
), ids AS (SELECT *, sha256(record_type || '|' || refers_to) AS r FROM blocks)
SELECT page_id, record_type,
  '<urn:uuid:' || r[1:8] || '-' || r[9:12] || '-' || r[13:16] || '-' || r[17:20] || '-' || r[21:32] || '>' AS record_id,
  refers_to, target_uri, date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest,
  source_block_digest, source_payload_digest, block
FROM ids
""".replace("@names", _names_sql()).replace("@text", _entities_sql("stripped.t")).replace("@title", _entities_sql("raw_title")).replace("@link", _entities_sql("v"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text, and digests of the texts without the repeats."""
    return runs.report(table(spark, sf_dir, "documents"))


@query
def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, and its shard once one more joins."""
    return sharding.report(table(spark, sf_dir, "documents"))


# The checksum is computed byte by byte, as this engine has none.
CHECKS["op12_rendezvous_shards"] = r"""
WITH entries AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), bytes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents
), summed AS (
  SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM bytes, entries
), drawn AS (
  SELECT *, list_transform(range(17), lambda s:
    1.0 / -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS d
  FROM summed
), placed AS (
  SELECT *, list_position(d[1:16], list_max(d[1:16])) - 1 AS shard FROM drawn
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), k, size, text_crc32) - 1 AS slot,
       (CASE WHEN d[17] > list_max(d[1:16]) THEN 16 ELSE shard END)::INTEGER AS grown_shard
FROM placed
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all usable embeddings."""
    return whitening.report(table(spark, sf_dir, "embeddings"))
