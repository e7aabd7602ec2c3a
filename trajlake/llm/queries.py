"""The queries of this subpackage and the SQL they are compared with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_repair import repaired_conversations
from .exact_dedup import exact_dedup
from .katz import katz_scores
from .line_dedup import line_report
from .minhash_dedup import minhash_dedup
from .ngram_join import ngram_join
from .packing import pack
from .piece_sampling import sample_segmentations
from .token_alignment import align_tokenizers
from .topk_search import topk_search
from .toxicity import toxicity
from .training_order import training_order
from .warc import deduplicated_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


@query("op1_exact_dedup", sql=r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_warc_revisits", sql="""
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""")
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(table(spark, sf_dir, "pages"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op3_minhash_dedup")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), size=2)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query("op5_topk_search", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"))


@query("op10_katz_backoff")
def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), order=3)


@query("op9_piece_sampling")
def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_segmentations(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "sample", "pieces", "log_prob", "perturbed", "inclusion", "round_trip", F.crc32("ids").alias("ids_crc32"))


@query("op7_training_order")
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training_order(table(spark, sf_dir, "documents"))
    return out.select("slot", "shard", "doc_id", "sequence", "length", F.crc32("ids").alias("ids_crc32"))


def _step(x: str, cost: str, letter: str) -> str:
    """SQL: a prefix ``cost in nine digits || audit`` with one more edit; null stays null."""
    return f"(printf('%09d', CAST(substr({x}, 1, 9) AS BIGINT) + {cost}) || substr({x}, 10) || {letter})"


def _edits_sql() -> str:
    """SQL: the cheapest prefix per state of a conversation (start, system, user, assistant), turn by turn over ``kinds``."""
    keep = "CASE WHEN k <> lower(k) THEN 5 ELSE 0 END"
    gone, write = (lambda i: _step(f"b[{i}]", "2", "'D'")), (lambda i: f"CASE WHEN k <> 'x' THEN {_step(f'b[{i}]', f'1 + {keep}', chr(39) + 'R' + chr(39))} END")
    stay = lambda i, c: f"CASE WHEN lower(k) = '{c}' THEN {_step(f'b[{i}]', keep, chr(39) + 'K' + chr(39))} END"
    rows = [gone(1), f"least({gone(2)}, {stay(1, 's')})", f"least({', '.join([gone(3), *(f(i) for i in (1, 2, 4) for f in (write, lambda i: stay(i, 'u')))])})", f"least({gone(4)}, {write(3)}, {stay(3, 'a')})"]
    insert = lambda x, n=1: _step(x, str(5 * n), f"'{'I' * n}'")
    close = lambda y: f"list_transform([{y}], lambda y: [y[1], y[2], least(y[3], {insert('y[1]')}, {insert('y[2]')}, {insert('y[4]')}), least(y[4], {insert('y[3]')}, {insert('y[1]', 2)}, {insert('y[2]', 2)})])[1]"
    return f"list_reduce(kinds, lambda b, k: {close('[' + ', '.join(rows) + ']')}, {close('[repeat(chr(48), 9), NULL, NULL, NULL]')})"


@query("op12_conversation_repair", sql=rf"""
WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
faulty AS (SELECT *, xor(list_reduce(list_transform(range(length(k)), lambda i: CAST(ascii(k[i + 1]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS fault FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM faulty WHERE fault <> 0)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(sha256(text), 1, 32)) AS n FROM damaged),
marked AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS pair FROM ordered),
kinds AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
          count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
          list(CASE WHEN blank OR again THEN 'x' WHEN cut THEN upper(kind) ELSE kind END ORDER BY n) AS kinds
          FROM (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS kind FROM marked) GROUP BY conv_id),
solved AS (SELECT * EXCLUDE (kinds, b), CAST(substr(least(b[1], b[4]), 1, 9) AS BIGINT) AS cost, substr(least(b[1], b[4]), 10) AS audit FROM (SELECT *, {_edits_sql()} AS b FROM kinds)),
letters AS (SELECT conv_id, i, substr(audit, i, 1) AS edit FROM (SELECT conv_id, audit, CAST(unnest(range(1, length(audit) + 1)) AS BIGINT) AS i FROM solved)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM letters),
kept AS (SELECT p.conv_id, p.i, p.edit, o.role, CASE WHEN p.edit = 'I' THEN '' ELSE o.text END AS text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.i) AS j
         FROM placed p LEFT JOIN ordered o ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.n = o.n WHERE p.edit <> 'D'),
shifted AS (SELECT *, (j + first_value(CASE WHEN edit = 'K' AND substr(role, 1, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j)) % 2 AS odd FROM kept),
hashes AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM shifted GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN solved s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN hashes h ON c.conv_id IS NOT DISTINCT FROM h.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]


@query("op11_ngram_join", sql=r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM t),
c AS (SELECT row_number() OVER () AS c, g, len(g) AS n FROM (SELECT DISTINCT g FROM s WHERE len(g) > 0)),
e AS (SELECT c, n, unnest(g) AS x FROM c),
links AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, o) AS (SELECT c, c FROM c UNION SELECT reach.c, both.b FROM reach JOIN both ON reach.o = both.a),
low AS (SELECT reach.c, min(o.id) AS component_id FROM reach JOIN (SELECT c.c, min(doc_id) AS id FROM c JOIN s USING (g) GROUP BY c.c) o ON reach.o = o.c GROUP BY reach.c)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(low.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN low ON low.c = c.c""")
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
