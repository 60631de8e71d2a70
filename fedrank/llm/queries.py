"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hpy, lines, minhash, packing, quality, suffixes, tokens, windows


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; the default of the queries only, operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir), vocabulary(), limit=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicate_lines(table(spark, sf_dir), percent=90)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tokens.encode(table(spark, sf_dir), vocabulary(), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir), width=5, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.score(table(spark, sf_dir))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir), width=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir), keep="last")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.remove_shared_windows(table(spark, sf_dir), width=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir), vocabulary(), limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_bpe, op4_minhash, op5_quality, op6_language_model, op7_suffix_array, op8_exact_dedup, op9_substring_dedup, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL}


WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM d, range(1, greatest(len(ws) - 3, 2)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, y FROM r JOIN links ON o = x),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM d, range(1, len(ws) - 48) t(i)),
hits AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hits, range(i, i + 50) t(p)),
kept AS (SELECT d.doc_id, count(*) AS n, string_agg(ws[p], ' ' ORDER BY p) AS k FROM d, range(1, len(ws) + 1) t(p) ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.p = t.p GROUP BY ALL)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WHERE doc_id IS NOT NULL WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
