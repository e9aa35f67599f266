"""The numbered queries over the driver tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    bitslice, bpe, bwt, cotrain, credentials, crf, dualtree, huffman, jaccard, media, rendezvous, spelling,
    vector_packing,
)
from tallyloom.sources.workspace import new_table_path

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "token-files")
    huffman.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORDS), end=2)
    return huffman.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.sharded(table(spark, sf_dir, "documents"), [1.0] * 8)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.packed_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), end=1)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), threshold=0.8, words=5)


def op5_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt.removal_digest(table(spark, sf_dir, "documents"), length=400)
    return found.withColumn("has_repeat", F.col("n_removed") > 0)


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("spans", F.size("spans")).withColumnRenamed("spans", "n_spans")


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_text_media(table(spark, sf_dir, "documents"))


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op11_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_credential_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(credentials.secret_spans(table(spark, sf_dir, "documents")))


def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.code_digest(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 4) -> str:
    """Codes by comparing every part with every entry, round after round."""
    nearest = """
        SELECT v.rid, v.part, arg_min(struct_pack(e := b.entry, x := v.x), [
            list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry
        ]) AS hit,
        min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error
        FROM part_rows AS v JOIN {books} AS b ON v.part = b.part GROUP BY v.rid, v.part
    """
    steps = []
    for i in range(rounds):
        steps.append(f"""near{i} AS ({nearest.format(books=f"book{i}")}), sum{i} AS (
            SELECT part, hit.e AS entry, i, CAST(floor(sum(hit.x[i + 1]) / count(*)) AS BIGINT) AS mean
            FROM near{i}, range(16) AS r(i) GROUP BY ALL
        ), mean{i} AS (SELECT part, entry, list(mean ORDER BY i) AS x FROM sum{i} GROUP BY ALL
        ), book{i + 1} AS (
            SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{i} AS b LEFT JOIN mean{i} AS m USING (part, entry)
        )""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
                list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), part_rows AS (
            SELECT rid, part, q[16 * part + 1:16 * part + 16] AS x FROM kept, range(4) AS p(part)
        ), book0 AS (
            SELECT part, rid - 1 AS entry, x FROM part_rows WHERE rid <= 256
        ), {", ".join(steps)}, final AS ({nearest.format(books=f"book{rounds}")}), coded AS (
            SELECT k.vec_id, k.label, string_agg(lower(lpad(hex(CAST(hit.e AS BIGINT)), 2, '0')), '' ORDER BY part) AS code,
                CAST(sum(f.error) AS BIGINT) AS error
            FROM final AS f JOIN kept AS k USING (rid) GROUP BY k.rid, k.vec_id, k.label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_huffman_token_files, op2_rendezvous_shards, op3_vector_packing, op4_jaccard_join,
        op5_bwt_repeats, op6_bit_sliced_top_k, op7_crf_toxicity, op8_cotrained_quality,
        op9_media_columns, op10_segment_tree_bpe, op11_spelling_trie,
        op12_credential_automata, op13_dual_tree_codes,
    )
}
SQL: dict[str, str] = {
    "op2_rendezvous_shards": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k
            FROM documents
        ), crc_table AS (
            SELECT list(list_reduce(
                range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n
            ) ORDER BY n) AS t
            FROM range(256) AS r(n)
        ), s AS (
            SELECT doc_id, shard,
                1.0 / -ln((CAST('0x' || md5(k || ':' || shard)[1:12] AS BIGINT) + 0.5) / 281474976710656.0) AS score
            FROM d, range(9) AS r(shard)
        ), p AS (
            SELECT doc_id,
                CAST(arg_max(shard, score) FILTER (shard < 8) AS INTEGER) AS shard,
                CAST(arg_max(shard, score) AS INTEGER) AS grown_shard
            FROM s GROUP BY doc_id
        ), c AS (
            SELECT doc_id, octet_length(encode(body)) + 1 AS size,
                list_transform(
                    range(octet_length(encode(body))),
                    lambda i: CAST('0x' || h[2 * i + 1] || h[2 * i + 2] AS BIGINT)
                ) AS bytes
            FROM (SELECT *, string_split(hex(encode(body)), '') AS h FROM d)
        ), q AS (
        SELECT doc_id, CAST(size AS BIGINT) AS size,
            CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12] AS BIGINT)
                % greatest(64, (SELECT count(*) FROM documents) // 16384) AS part,
            xor(4294967295, list_reduce(
                bytes, lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295
            )) AS text_crc32,
            'key' AS law, shard, grown_shard
        FROM c JOIN p USING (doc_id), crc_table
        )
        SELECT * EXCLUDE (part),
            row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1 AS slot
        FROM q
    """,
    "op6_bit_sliced_top_k": """
        WITH v AS (
            SELECT vec_id, len(embedding) AS dim,
                list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM v AS a JOIN v AS b ON a.dim = b.dim AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0
        )
        SELECT query_id, vec_id, score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM s
        QUALIFY rank <= 10
    """,
    "op11_spelling_trie": """
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce(
                range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n
            ) ORDER BY n) AS t
            FROM range(256) AS r(n)
        ), runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
                unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS raw
            FROM documents
        ), lowered AS (
            SELECT k, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
            FROM runs GROUP BY ALL
        ), hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(
                list_transform(
                    range(octet_length(encode(k || ':' || run))),
                    lambda i: CAST('0x' || substring(hex(encode(k || ':' || run)), 2 * i + 1, 2) AS BIGINT)
                ),
                lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295
            )) AS h
            FROM lowered, crc_table
        ), typed AS (
            SELECT times, CASE WHEN h % 97 = 0
                THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
                ELSE run END AS word
            FROM hashed
        ), words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed
            WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ), shorter AS (
            SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS near FROM shorter AS a JOIN shorter AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, a.rest FROM shorter AS a JOIN words AS w ON a.rest = w.word
            UNION SELECT a.rest, a.word FROM shorter AS a JOIN words AS w ON a.rest = w.word
        ), ranked AS (
            SELECT x.word, x.near, w.n AS near_n, count(*) OVER (PARTITION BY x.word) AS n_near,
                row_number() OVER (PARTITION BY x.word ORDER BY w.n DESC, encode(x.near)) AS place
            FROM near AS x JOIN words AS w ON x.near = w.word
        ), told AS (
            SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
                CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form,
                CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
            FROM words AS w LEFT JOIN ranked AS r ON w.word = r.word AND r.place = 1
        ), chain AS (
            SELECT word, word AS at FROM told
            UNION ALL SELECT c.word, t.form FROM chain AS c JOIN told AS t ON c.at = t.word WHERE t.form IS NOT NULL
        )
        SELECT t.word, t.form, c.at AS root, t.n, t.n_near, t.form_n
        FROM told AS t JOIN chain AS c USING (word) JOIN told AS l ON l.word = c.at
        WHERE l.form IS NULL
    """,
    "op13_dual_tree_codes": _lloyd_sql(),
}
