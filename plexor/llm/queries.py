"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexor.llm import licenses, quality_fm, secrets
from plexor.llm.exact_dedup import exact_dedup
from plexor.llm.fill_middle import fill_in_middle
from plexor.llm.mixing import mix
from plexor.llm.ngram_join import near_duplicates
from plexor.llm.packing import pack_documents
from plexor.llm.prefix_trie import prefix_trie
from plexor.llm.quality_rules import quality_rules
from plexor.llm.sharding import shard
from plexor.llm.suffix_dedup import suffix_dedup
from plexor.llm.token_counts import count_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark, _documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.digest(secrets.secret_scan(docs, secrets.train(docs)))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_held_out()).select("doc_id", F.col("quality").alias("y"))
    scored = quality_fm.score(docs, quality_fm.train(docs, labels))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, _documents(spark, sf_dir), tokenizer_path())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, _documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, _documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, _documents(spark, sf_dir), tokenizer_path())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_documents(spark, sf_dir), outputs=False)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, _documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_vector_sharding, op2_ngram_jaccard_join, op3_secret_scan, op4_quality_fm, op5_quality_rules, op6_license_scan, op7_token_counts, op8_exact_dedup, op9_source_mixing, op10_best_fit_packing, op11_fill_in_middle, op12_suffix_dedup, op13_prefix_trie)}

SQL = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
        t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.c = t.a),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH k AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM k WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        h AS (SELECT *, len(l)::BIGINT AS n, ('0x' || k[1:8])::BIGINT AS h1, ('0x' || k[9:16])::BIGINT AS h2, ('0x' || k[17:24])::BIGINT AS h3, ('0x' || k[25:32])::BIGINT AS h4 FROM t),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
              CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        c AS (SELECT *, array_to_string(l[1:lo], '') AS p, array_to_string(l[lo + 1:hi], '') AS m, array_to_string(l[hi + 1:], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
        FROM c""",
    "op12_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
        s AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS w FROM (SELECT *, unnest(range(n - 49)) AS i FROM t WHERE n >= 50)),
        f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
        m AS (SELECT doc_id, i, first < doc_id AS gone FROM s JOIN f USING (w)),
        g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM m WHERE gone),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
        c AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before FROM r),
        k AS (SELECT c.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM c JOIN t USING (doc_id) GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
        FROM t LEFT JOIN k USING (doc_id)""",
    "op13_prefix_trie": r"""
        WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, crc % 6 AS h, c - c % 100 AS b FROM (SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                  lambda s, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(s, b)), 4294967295), 4294967295) AS crc FROM (SELECT DISTINCT c FROM o))),
        r AS (SELECT h.c, o.i, o.role, o.text FROM h JOIN o ON o.c = h.b AND o.i <= h.h UNION ALL SELECT o.c, 1000000 + o.i, o.role, o.text FROM o JOIN h USING (c) WHERE o.i > h.h),
        t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text FROM r),
        p AS (SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS k, d = count(*) OVER (PARTITION BY c) AS ended FROM t
              UNION ALL SELECT c, 0, '', [], NOT EXISTS (SELECT 1 FROM t WHERE t.c = h.c) FROM h),
        n AS (SELECT *, min(c) OVER (PARTITION BY d, k) AS m FROM p),
        a AS (SELECT n.d, n.m, count(*) AS n_convs, any_value(q.m) AS parent, any_value(length(n.text)) AS chars,
                     string_agg(CASE WHEN n.ended THEN n.c::VARCHAR END, ',' ORDER BY n.c) AS ends FROM n LEFT JOIN n q ON q.c = n.c AND q.d = n.d - 1 GROUP BY 1, 2),
        k AS (SELECT a.*, (SELECT count(*) FROM a x WHERE x.d = a.d + 1 AND x.parent = a.m) AS n_children FROM a),
        u AS (SELECT n.d, n.m, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.chars)::BIGINT AS saved_tokens FROM k JOIN n ON n.c = k.m AND n.d <= k.d GROUP BY 1, 2)
        SELECT k.m AS conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
        FROM k JOIN u ON u.d = k.d AND u.m = k.m""",
}
