"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, oracles, secret_scan, vector_codes
from .ann import nearest
from .fingerprint import compare_with_edits, containment, distinct_count, to_text
from .html_text import extract_text
from .license_scan import scan_licenses
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, held_out, score_quality
from .sentencepiece_codec import round_trip
from .substring_dedup import remove_repeats
from .url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of the url query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules and by its redirect aliases."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases in all documents by diagonal voting."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the public byte-pair model and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all documents, against their edited texts and the next documents."""
    out = compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_text(F.col("sketch")).alias("fingerprint"), to_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", distinct_count(F.col("sketch")).alias("n_distinct"), containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, Jaccard of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the files lie beside the installed libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_tokens=False)
    return out.drop("tokens")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 13-word windows removed from all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by rules whose candidates a trigram index gives."""
    kinds = [r.kind for r in secret_scan.RULES]
    base = len(secret_scan.BASE)
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    own = F.filter("spans", lambda s: s["rule"] < base)
    number = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{kinds[k]}") for k in range(base)], F.sha2(secret_scan.span_text(own, kinds).cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans"), kinds).alias("spans"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: four parts, 256 entries each, four rounds."""
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_errors(made.codes)
    return out.select("vec_id", vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error", vector_codes.digests(made.books, F.col("size")).alias("codebooks_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule on their rows, and repaired at the least cost."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(rows)).select("conv_id", *conversation_repair.COUNTS, "audit", "repaired_sha256")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the others are tested against brute force."""
    return {
        "op1_url_filter": oracles.url_filter(URL_RULES),
        "op4_license_scan": oracles.license_scan(),
        "op5_minhash_near_dedup": oracles.near_duplicates(3, 85),
        "op10_substring_dedup": oracles.substring_dedup(13),
        "op11_secret_scan": oracles.secret_scan(secret_scan.RULES, len(secret_scan.BASE)),
        "op12_vector_codes": oracles.vector_codes(4, 256, 4),
        "op13_conversation_repair": oracles.conversation_repair(),
    }
