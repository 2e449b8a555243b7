"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.session import ship_package

from . import attention_lm, kneser_ney, mixing, packing, quality_rules, records, sharding, simhash, tiff, token_counts
from .common import fresh_path


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, installed on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.stored_texts(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = tiff.decode_documents(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    # Bytes are taken for text and back, which leaves them as they are, to be joined at once.
    read = read.withColumn("payload", F.array_join(F.transform("pages", lambda p: p["pixels"].cast("string")), "").cast("binary"))
    first, rows = F.col("pages")[0], F.aggregate("pages", F.lit(0), lambda a, p: a + p["height"])
    mean = F.aggregate("pages", F.lit(0.0), lambda a, p: a + p["mean"] * p["height"]) / rows
    scheme = F.concat_ws("/", first["compression"], first["predictor"], first["tiled"])
    feature = F.concat_ws(";", F.concat(F.lit("pages="), F.size("pages")), F.concat(F.lit("rows="), rows), F.concat(F.lit("scheme="), scheme), F.concat(F.lit("mean="), F.format_number(mean, 3)))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), "error",
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(table(spark, sf_dir, "documents"))


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = records.write_records(docs, fresh_path(spark, "records"), vocabulary("byte_bpe_50k.json"))
    return records.read_records(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality_rules.RULES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


# --- parts of the above that SQL can express -------------------------------------------------


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of operator 2, by source."""
    rows = mixing.mix_sources(table(spark, sf_dir, "documents")).groupBy("source", "source_size")
    return rows.agg(F.round(F.max("target"), 3).alias("target"), F.count("*").alias("documents"), F.sum("size").alias("words"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of operator 8."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_tiff_pages, op2_source_mix, op3_token_counts, op4_packing, op5_interleaved_shards, op6_binary_records, op7_kneser_ney, op8_quality_rules, op9_simhash, op10_attention_lm, mix_targets, quality_base)
}

_WORD = r"[^\x20\x09-\x0D]+"

#: Tokenizers, trained models, seeded 64-bit hashes and CRC-32 have no DuckDB form; the opN queries are
#: tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    # Targets are the lesser of three times a source's size and one level times its weight: sources by
    # the level at which they are full, and the first whose level is not reached by what is left.
    "mix_targets": f"""WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))) AS size, count(*) AS documents FROM documents GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(size) OVER () AS total FROM s),
        f AS (SELECT *, 3.0 * size / weight AS full_at FROM w WHERE size > 0),
        l AS (SELECT *, (total - 3.0 * coalesce(sum(size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
        x AS (SELECT coalesce(arg_min(level, full_at) FILTER (level <= full_at), max(full_at)) AS level FROM l)
        SELECT source, CAST(size AS BIGINT) AS source_size, round(CAST(least(3.0 * size, weight * level) AS DOUBLE), 3) AS target, documents, CAST(size AS BIGINT) AS words FROM w, x""",
    "quality_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
        g AS (SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS window3 FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, window3) AS n FROM g) WHERE n > 1),
        c AS (SELECT id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id),
        o AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (id))
        SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o""",
}
