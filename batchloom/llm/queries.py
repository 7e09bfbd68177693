"""One query for each operator over its whole table, and the pipeline, with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.byte_bpe import encode_texts, ids_text
from batchloom.llm.decontaminate import contaminated
from batchloom.llm.fill_in_middle import output_digests
from batchloom.llm.language_id import predict_language
from batchloom.llm.language_model import score_texts
from batchloom.llm.license_scan import scan_licenses
from batchloom.llm.merkle import manifest
from batchloom.llm.near_dedup import near_duplicates
from batchloom.llm.quality import judge_quality
from batchloom.llm.shards import assign_shards
from batchloom.llm.substring_dedup import remove_repeats
from batchloom.llm.token_files import document_digests, write_tokens
from batchloom.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# fixed values: the rules that the query applies
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# links between pages are absolute canonical ones here; the operator reads more kinds
OP1_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), links AS (
  SELECT url AS source,
         unnest(list_transform(
           list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>'),
                       lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?\s*canonical\b')),
           lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*"([^"]*)"', 1))) AS target
  FROM pages
), urls AS (
  SELECT page_id, url FROM pages
  UNION ALL SELECT NULL, target FROM links WHERE target LIKE '%://%'
), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest, url
  FROM urls
), judged AS (
  SELECT p.page_id, p.host, p.path, CASE WHEN p.url LIKE '%://%' THEN p.host || p.rest END AS node,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS own
  FROM (SELECT row_number() OVER () AS n, * FROM parts) p
  LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY p.n, p.page_id, p.host, p.path, p.url, p.rest
), keyed AS (
  SELECT url, CASE WHEN url LIKE '%://%' THEN host || rest END AS node FROM parts
), edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b
  FROM links l JOIN keyed a ON a.url = l.source JOIN keyed b ON b.url = l.target WHERE a.node <> b.node
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(node, other) AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), alias AS (
  SELECT reach.node, min(judged.own) AS verdict
  FROM reach JOIN judged ON judged.node = reach.other WHERE judged.own IS NOT NULL GROUP BY reach.node
)
SELECT page_id, host, path, rule, coalesce(own, alias.verdict, 'allow') AS verdict
FROM judged LEFT JOIN alias USING (node) WHERE page_id IS NOT NULL
"""


@query("op1_url_filters", OP1_SQL)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return document_digests(write_tokens(docs, path, vocabulary=50_257, end_id=2))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35
), windows AS (
  SELECT s.doc_id, s.i, array_to_string(list_slice(words.w, s.i, s.i + 34), ' ') AS seq
  FROM starts s JOIN words USING (doc_id)
), repeated AS (
  SELECT doc_id, i FROM windows
  WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS at
  FROM repeated, unnest(range(0, 35)) AS t(j) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(gone.at), 0) AS n_removed,
         CASE WHEN gone.at IS NULL THEN w
              ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone.at, x)))
         END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""


@query("op3_substring_dedup", OP3_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    coded = encode_texts(docs, path, decode=True)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    return judge_quality(docs, labels).drop("text")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict_language(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.a, x.b
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both
        FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2) x
  JOIN sizes n ON n.doc_id = x.a JOIN sizes m ON m.doc_id = x.b
  WHERE 100 * x.both >= 80 * (n.n + m.n - x.both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM edges
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), groups AS (
  SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce(g.least, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(g.least, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN groups g USING (doc_id)
"""


@query("op10_near_dedup", OP10_SQL)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), width=4)


# CRC-32 over the bytes of a text, by a table of what each byte adds
CRC_TABLE = """
SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
       lambda d, k: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab
FROM range(256) r(i)"""


def crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


# the smallest capacity by dynamic programming over all cuts, where the operator searches for it
OP11_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         {crc32_sql("coalesce(text, '')")} AS text_crc32,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents, crc
), groups AS (
  SELECT k, sum(size)::BIGINT AS bytes FROM rows GROUP BY k
), largest AS (
  SELECT k, row_number() OVER w AS i,
         bytes * (17 - row_number() OVER w) >= sum(bytes) OVER () - (sum(bytes) OVER w - bytes) AS big
  FROM groups WINDOW w AS (ORDER BY bytes DESC, k ROWS UNBOUNDED PRECEDING)
), alone AS (
  SELECT k, i FROM largest WHERE i < 16 AND i < coalesce((SELECT min(i) FROM largest WHERE NOT big), 17)
), ends AS (
  SELECT k, row_number() OVER (ORDER BY k) AS i, sum(bytes) OVER (ORDER BY k)::BIGINT AS e
  FROM groups WHERE k NOT IN (SELECT k FROM alone)
), left_shards AS (
  SELECT 16 - count(*) AS n FROM alone
), best(s, i, c) AS (
  SELECT 1, i, e FROM ends
  UNION ALL
  SELECT b.s + 1, p.i, min(greatest(b.c, p.e - q.e))
  FROM best b JOIN ends q ON q.i = b.i JOIN ends p ON p.i >= q.i, left_shards
  WHERE b.s < n GROUP BY b.s, p.i
), least AS (
  SELECT min(c) AS capacity FROM best WHERE i = (SELECT max(i) FROM ends)
), cuts(s, reached) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT c.s + 1, max(e) FROM cuts c JOIN ends
    ON e <= c.reached + (SELECT capacity FROM least) AND e > c.reached
  GROUP BY c.s, c.reached
), of_group AS (
  SELECT ends.k, (16 - n + count(cuts.reached))::INTEGER AS shard
  FROM ends CROSS JOIN left_shards LEFT JOIN cuts ON cuts.s > 0 AND cuts.reached < ends.e
  GROUP BY ends.k, n
  UNION ALL SELECT k, (i - 1)::INTEGER FROM alone
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), k, size, doc_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM rows JOIN of_group USING (k)
"""


@query("op11_shards", OP11_SQL)
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents", "doc_id", "text"), n_shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    coded = [
        f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f})) || ':' || {f} END" for f in fields
    ]
    return f"sha256({' || '.join(coded)})"


OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n, {leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0
              THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS now
  FROM documents, crc
), nodes(source, level, place, n, h) AS (
  SELECT source, 0, place, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY source, level, place // 3, (n + 2) // 3
), subroots AS (
  SELECT source, h, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
         count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops(level, place, n, h) AS (
  SELECT 0, place, n, h FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // 3, (n + 2) // 3
), steps AS (
  SELECT l.doc_id, x.level AS step,
         coalesce(string_agg(x.h, '' ORDER BY x.place) FILTER (x.place < o.own), '') AS lefts,
         coalesce(string_agg(x.h, '' ORDER BY x.place) FILTER (x.place > o.own), '') AS rights
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1,
       LATERAL (SELECT l.place // pow(3, x.level)::BIGINT AS own) o
  WHERE x.place // 3 = o.own // 3 GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, s.depth + t.level,
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place < o.own), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place > o.own), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n > 1,
       LATERAL (SELECT s.place // pow(3, t.level)::BIGINT AS own) o
  WHERE t.place // 3 = o.own // 3 GROUP BY ALL
), proofs AS (
  SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256
  FROM steps GROUP BY doc_id
), folds(doc_id, step, h) AS (
  SELECT doc_id, 0, now FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(lefts || h || rights) FROM folds f JOIN steps USING (doc_id, step)
), folded AS (
  SELECT doc_id, arg_max(h, step) AS folded_root FROM folds GROUP BY doc_id
), root AS (
  SELECT h AS root FROM tops WHERE n = 1
)
SELECT l.doc_id, leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
LEFT JOIN proofs USING (doc_id) JOIN folded USING (doc_id), root
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit("")))
    return manifest(docs, claimed=tampered)


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w
  FROM documents
), drawn AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1,
         ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3,
         ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM units
), parts AS (
  SELECT doc_id, n, t,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         coalesce(array_to_string(list_slice(w, 1, low), ''), '') AS head,
         coalesce(array_to_string(list_slice(w, low + 1, high), ''), '') AS middle,
         coalesce(array_to_string(list_slice(w, high + 1, n), ''), '') AS tail
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
