"""One query per operator, over its whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import decontamination, language_model, licenses, media, near_dedup, packing, quality, repeats, source_audit, toxicity, url_filters, vector_codes, warc
from telemill.llm.store import written

BPE_FILE = "byte_bpe_50k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "lang", "n_units", "log10_p", "perplexity", "threshold", "keep")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held"))
    return language_model.score(docs, "held")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode_media(table(spark, sf_dir, "documents")), "media")
    return media.read_media(stored)


def captures_of(pages: DataFrame) -> DataFrame:
    """Each page as a full response, and a later not-modified revisit of it."""
    minute = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    digest = F.sha1("html")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + minute)
    again = F.timestamp_seconds(F.lit(1_700_000_000) + minute + 3600 + F.pmod(F.col("page_id") * 7919, F.lit(30 * 86_400)))
    modified = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    response = pages.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        digest.alias("digest"),
    )
    revisit = pages.select(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.date_format(again, "yyyy-MM-dd HH:mm:ss")).alias("headers"),
        digest.alias("digest"),
    )
    return response.unionByName(revisit)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve(captures_of(table(spark, sf_dir, "pages")))
    header = lambda k: F.col("headers")[k]
    return got.select(
        "record_id", "url_key", "outcome", "response_id", "response_digest",
        F.unix_seconds("ts").alias("ts_s"), F.unix_seconds("response_ts").alias("response_s"),
        header("etag").alias("etag"), header("last-modified").alias("last_modified"), header("content-length").alias("content_length"), header("cache-control").alias("cache_control"), header("date").alias("date_header"),
    )


def remainder(n: int):
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels.where(remainder(4) != 2), thresholds=False)
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (F.coalesce(remainder(4), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.recognise(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_url_filters": op5_url_filters,
    "op6_language_model": op6_language_model,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_repeats": op11_repeats,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_audit": op13_source_audit,
}
