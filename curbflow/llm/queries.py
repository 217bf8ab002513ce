"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# Words of a text in SQL: runs of anything but the six white-space characters.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+')"


@query("op6_byte_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.byte_shards import shard_by_bytes, text_bytes

    sizes = table(spark, sf_dir, "documents").select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_by_bytes(sizes, 40, tie="text_crc32").withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


@query("op7_mix_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.source_mix import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).documents.drop("_row", "source")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents
), m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0b\\x0c\\r]')) AS ls,
    w
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM m WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (
    SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id
), r AS (
  SELECT m.doc_id, source, n_words, word_chars, n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r
), h AS (
  SELECT source, count(*) AS documents,
    count(*) FILTER (WHERE base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines) AS failures
  FROM f GROUP BY source
), moments AS (
  SELECT sum(failures)::DOUBLE / sum(documents) AS mean,
    sum(documents * (failures::DOUBLE / documents) * (failures::DOUBLE / documents)) / sum(documents)
      - (sum(failures)::DOUBLE / sum(documents)) * (sum(failures)::DOUBLE / sum(documents)) AS variance
  FROM h
), prior AS (
  SELECT mean, CASE WHEN variance > 1e-12 THEN least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1000.0)
    ELSE 1000.0 END AS strength FROM moments
), hosts AS (
  SELECT source, (failures + strength * mean) / (documents + strength) <= 0.5 AS host_kept FROM h, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_kept AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source
"""


@query("op9_host_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.host_rules import host_rules

    return host_rules(table(spark, sf_dir, "documents")).drop("source", "host_rate")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.token_files import find_documents, key_occurrences, read_digests, write_token_files
    from curbflow.session import scratch_path

    docs = table(spark, sf_dir, "documents")
    files = write_token_files(docs, scratch_path(spark, "token-files"))
    found = find_documents(files, key_occurrences(docs))
    return read_digests(files, found).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op10_piece_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.piece_codec import encode_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


@query("op1_va_search", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.va_search import exact_top_k, scaled, usable

    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    return exact_top_k(rows.select("vec_id", scaled(F.col("embedding"), 64).alias("v")), F.col("vec_id") % 20 == 0)


@query("op5_reply_trees")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.reply_trees import chain_of_turns, conversation_digests, format_branches

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_branches(chain_of_turns(rows))).withColumnRenamed("conversation", "conv_id")


@query("op4_quality_mil")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.quality_mil import in_fold, score_quality, train_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels").filter(~in_fold("doc_id", 1)))
    return score_quality(docs, model).select(
        "doc_id", in_fold("doc_id", 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit
), lost AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.common import word_array
    from curbflow.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.array_join(word_array(F.col("text")), " ")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON d.doc_id = a
"""


@query("op8_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.jaccard_join import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h,
    regexp_extract_all(coalesce(text, ''), '[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+') AS u
  FROM documents
), n AS (
  SELECT doc_id, t, u, len(u) AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM n
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""


@query("op11_fill_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_jacobi_davidson")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op12_katz_backoff")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curbflow.llm.katz_backoff import score_texts
    from curbflow.llm.quality_mil import in_fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, ~in_fold("doc_id", 1, 5)).select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
