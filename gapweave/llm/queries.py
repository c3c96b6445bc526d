"""One query per corpus operator, over whole tables of the given folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm.arc_warc import convert_pages
from gapweave.llm.decontaminate import contaminated
from gapweave.llm.filter_audit import audit_text_filters
from gapweave.llm.license_scan import scan_licenses
from gapweave.llm.line_dedup import drop_boilerplate
from gapweave.llm.minhash_icws import near_duplicates
from gapweave.llm.mixing import in_training_order, mix_sources
from gapweave.llm.preferences import format_preferences, reply_pairs
from gapweave.llm.quality_rules import kept, ledger
from gapweave.llm.spelling_variants import spelling_variants
from gapweave.llm.suffix_dedup import removed_spans
from gapweave.llm.wavelet_ids import encode_corpus, read_documents
from gapweave.llm.zstd_quality import fit_quality, held_out, score_quality


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = in_training_order(mix_sources(table(spark, folder, "documents").select("doc_id", "source", "text")))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        "copies",
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"),
    )


def op3_license_dice(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumn("dice", F.round("dice", 6))


def op4_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = removed_spans(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op5_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    book = ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~kept("v1")).alias("base_failed"),
        kept("v3").alias("kept"),
        "failed",
    )


def op6_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return convert_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op8_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    out = format_preferences(reply_pairs(table(spark, folder, "conversations")))
    spans = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","
    )
    return out.withColumns({"chosen_spans": spans("chosen_spans"), "rejected_spans": spans("rejected_spans")})


def op9_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source").select("doc_id", "source", "n_lines", "n_dropped", "text")


def op10_zstd_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_wavelet_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return read_documents(encode_corpus(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op13_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return audit_text_filters(docs, table(spark, folder, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_string_tiling,
        op2_curriculum_mix,
        op3_license_dice,
        op4_suffix_array,
        op5_rule_ledger,
        op6_arc_to_warc,
        op7_weighted_minhash,
        op8_preference_pairs,
        op9_site_lines,
        op10_zstd_quality,
        op11_wavelet_ids,
        op12_spelling_variants,
        op13_filter_interactions,
    )
}
