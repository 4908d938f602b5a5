"""The operators' queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import crc_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_segments", "segments")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_column

    return encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), crc_mod("doc_id", 10) != 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import removal

    return removal(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("chain")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licences

    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import verdicts

    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import mix

    return mix(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import interactions

    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_lm_score": op3_lm_score,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_mix": op11_mix,
    "op12_alignment": op12_alignment,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op6_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        m AS (SELECT page_id, html, CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN last IS DISTINCT FROM page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
        FROM m""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op11_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
        w AS (SELECT source, source_size, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS total FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source) AS r FROM w),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
        t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT min_by(level, r) FROM l WHERE weight * level <= cap)) AS target FROM w),
        r AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, target - pass * source_size AS left_ FROM r, (VALUES (0), (1)) AS u(pass)),
        k AS (SELECT *, CASE WHEN left_ >= source_size THEN 1 WHEN left_ <= 0 THEN 0 WHEN upto <= left_ THEN 1 WHEN upto - size < left_ AND (left_ - upto + size) * 2 >= size THEN 1 ELSE 0 END AS is_in FROM p)
        SELECT doc_id, size, source_size, target, CAST(sum(size * is_in) AS BIGINT) AS taken FROM k GROUP BY doc_id, size, source_size, target, upto""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
              FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
        e AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM e a, e b, e c, e d, e e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS prior FROM o, (VALUES (1), (2), (3), (4), (5)) AS u(step)),
        r AS (SELECT part, filter_order, step, own,
                     CAST(sum(CASE WHEN (mask & own) = 0 AND (mask & CAST(prior AS INTEGER)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                     CAST(sum(CASE WHEN (mask & own) > 0 AND (mask & CAST(prior AS INTEGER)) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                     CAST(sum(CASE WHEN (mask & own) > 0 AND (mask & CAST(prior AS INTEGER)) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                     CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                     CAST(sum(CASE WHEN (mask & own) > 0 AND (mask & CAST(prior AS INTEGER)) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                     CAST(sum(CASE WHEN (mask & own) > 0 AND (mask & CAST(prior AS INTEGER)) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
