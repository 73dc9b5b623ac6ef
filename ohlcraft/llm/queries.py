"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lang_ecoc, licenses, line_rules, ngram_join, packing, quality_fm, secrets_markov, substring, suffix_merge, token_alignment, vector_codes, warc_fixity
from .common import table, written


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def byte_bpe() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality_fm.score(docs, quality_fm.train(docs, labels))
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_markov.secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets_markov.as_text(base), 256).alias("base_sha256"), secrets_markov.as_text(F.col("spans")).alias("spans"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **byte_bpe())


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coder = lang_ecoc.train(docs.where(_fold(5) != 0))
    return lang_ecoc.predict(docs, coder).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op8_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records against a replica that a rule damages."""
    held = warc_fixity.damaged(warc_fixity.to_records(table(spark, sf_dir, "pages"))).drop("record")
    index = written(warc_fixity.lay_out(held), "index")
    replica = index.where("other IS NOT NULL").select("file", "offset", F.col("other").alias("sha256"))
    return warc_fixity.audit(index, index.select("file", "offset", "sha256"), replica)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = token_alignment.byte_level(**byte_bpe()), token_alignment.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b)


def op12_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_merge.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(books.text()), 256).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_rules": line_rules.ORACLE, "op10_warc_fixity": warc_fixity.ORACLE, "op13_segment_mean_codes": vector_codes.ORACLE}
