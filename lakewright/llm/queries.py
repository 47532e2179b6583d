"""The opN_ queries: each applies an operator of this subpackage to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, embedding_dedup, language_id, license_scan, mixing, packing, simhash_dedup, substring_dedup, suffix_dedup, token_alignment, token_counts, topk_search, url_filter


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; it is the same on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the contract's rules, then by its class of redirects."""
    return url_filter.url_filter(spark, _read(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; without target weights, sources keep the proportions they have."""
    pieces = packing.pack(spark, _read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, linked at three bits or fewer."""
    found = simhash_dedup.simhash_components(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four documents and predicts all."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(spark, docs.filter(~language_id.held_out()))
    found = language_id.identify(spark, docs.withColumn("held_out", language_id.held_out()), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages", "shares")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked within their label at a cosine of 0.93 and more."""
    return embedding_dedup.embedding_dedup(spark, _read(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice phrases and identifier expressions of all documents."""
    found = license_scan.license_scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others, in whole numbers."""
    return topk_search.top_k(spark, _read(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the default tree of weights selects."""
    return mixing.mix(spark, _read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: a cut in its first third, an insertion in the middle, another end."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda pos, cut, put: F.struct(pos.cast("long").alias("pos"), F.lit(cut).cast("long").alias("cut"), put.alias("put"))
    edits = F.array(
        edit(F.floor(size / 3), 40, F.lit("")),
        edit(F.floor(size / 2), 0, F.concat(F.lit(" revision "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" of this passage\n"))),
        edit(F.greatest(size - 50, F.lit(0)), 12, F.lit("closing words.")),
    )
    docs = _read(spark, sf_dir, "documents").withColumn("edits", edits)
    return token_counts.count_tokens(docs, tokenizer_path("word_bpe_49k.json"), edits_col="edits", with_text=False)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a 13-word window of an earlier one covers."""
    found = substring_dedup.substring_dedup(spark, _read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 50-byte string of an earlier one covers."""
    found = suffix_dedup.suffix_dedup(spark, _read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation by its rows' hashes and repairs what is left."""
    rows = _read(spark, sf_dir, "conversations")
    return conversation_repair.repair(spark, conversation_repair.damage(rows), ids=rows).report


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks are those of byte_bpe_50k.json, and special tokens' strings are plain text with them."""
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return token_alignment.align_documents(spark, docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_simhash_dedup, op4_language_id, op5_embedding_dedup, op6_license_scan, op7_topk_search, op8_mixing, op9_token_counts, op10_substring_dedup, op11_suffix_dedup, op12_conversation_repair, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.oracle_sql(),
    "op8_mixing": mixing.oracle_sql(),
}
