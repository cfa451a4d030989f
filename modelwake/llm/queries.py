"""The corpus operators as queries over the whole given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelwake.llm import bestfit, exact, frames, lines, minhash, mixing, packing, pii, quality, simhash, suffixes, trie, urls
from modelwake.session import scratch_path


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), width=3, percent=85)


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged_urls(read(spark, folder, "pages"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_dedup(read(spark, folder, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_pieces(read(spark, folder, "documents"), tokenizer_path())


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read(spark, folder, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.edited_fingerprints(read(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = exact.DigestIndex(spark, scratch_path(spark, "digest-index"))
    found = exact.duplicates_by_halves(read(spark, folder, "documents"), index)
    index.close()
    return found


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sources(read(spark, folder, "documents"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return frames.output_digests(frames.fill_in_middle(read(spark, folder, "documents")))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.best_fit_pieces(read(spark, folder, "documents"), tokenizer_path())


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(read(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_fill_in_middle": """
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        drawn AS (
            SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2,
                   ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4
            FROM hashed),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                   WHEN 'psm' THEN '<P>' || substr(text, 1, p) || '<S>' || substr(text, m + 1) || '<M>' || substr(text, p + 1, m - p)
                   ELSE '<S>' || substr(text, m + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, m - p) END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut""",
    "op13_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn, coalesce(role, '') AS role
            FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (
            SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS pos FROM turns),
        ids AS (
            SELECT conv_id, conv_id - conv_id % 20 AS first_id, (4294967295 - list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM placed)),
        rebuilt AS (
            SELECT i.conv_id, 0 AS own, p.pos, p.digest, p.words FROM ids i JOIN placed p ON p.conv_id = i.first_id AND p.pos < i.h
            UNION ALL SELECT i.conv_id, 1, p.pos, p.digest, p.words FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.pos >= i.h),
        paths AS (
            SELECT conv_id, words, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
        members AS (SELECT conv_id, depth, path, words FROM paths UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
        lasts AS (SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id),
        ended AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM lasts GROUP BY path),
        nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM members GROUP BY path, depth),
        children AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        tops AS (
            SELECT left(n.path, 32 * t.d::INT) AS path, sum(n.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
            FROM nodes n LEFT JOIN children c USING (path), unnest(range(0, n.depth + 1)) AS t(d) GROUP BY 1)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, t.leaves AS n_leaves,
               t.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
        FROM nodes n JOIN tops t USING (path) LEFT JOIN children c USING (path) LEFT JOIN ended e USING (path)
        LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1)::INT)""",
}
