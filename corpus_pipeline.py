"""From documents to training sequences: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import language_id, mixing, packing, simhash_dedup, substring_dedup
from lakewright.llm._work import Scratch
from lakewright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that random letters explain better than any learned language.

    Learns from the labels there are; a missing label becomes the predicted one. Null, empty and blank texts go; if there
    are no labels at all, nothing is known and all go. Texts of any length count whole. Rows are judged one by one: null ids stay
    null, repeated rows share a fate, and of equally likely languages the first by name is predicted. An empty table stays
    empty; columns besides those of documents are left out, whatever their names.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.train(spark, docs)
    found = language_id.identify(spark, docs, model, keep=COLUMNS)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("fit") > 0))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, the one of the smallest id.

    A pair at exactly 0.8 is missed with a probability of some 0.0001 (see `_near`); a document that is not near another one always stays.

    Null, empty and blank texts are one group. A row without an id stays only where its whole group has none; of rows that share
    the smallest id, the one of the smallest hash of the text, and of equal rows any one. Texts of any length are compared whole. An
    empty table stays empty; columns besides those of documents are left out, whatever their names.
    """
    return simhash_dedup.deduplicate(spark, docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds, and documents of which nothing is left.

    Documents that lose nothing stay as they are, null, empty and blank ones included, and so do all rows without an id, which count
    against none. Rows of one id never count against each other; repeated rows lose the same words. Of a text that loses words the others are
    joined by single blanks and n_chars is their length. Texts of any length are searched whole. An empty table stays empty;
    columns besides those of documents are left out, whatever their names.
    """
    found = substring_dedup.substring_dedup(spark, docs, keep=("lang", "source", "n_chars"))
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the weights of domains, languages and sources.

    Tokens are runs between blanks here; the packing that follows counts those of a vocabulary, so shares hold for words. Null, empty and blank
    texts have no tokens and go. Null languages and sources are a name of their own; null ids stand last in their leaf. Rows of one
    id go by a hash of their text; of equal rows as many stay as the budget holds. The last document of a leaf is cut to the budget, to its first words
    joined by single blanks, however long it is. An empty table stays empty; columns besides those of documents are left out, whatever their names.
    """
    kept = mixing.select_mixture(spark, docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token in one piece of one sequence of 2048, the sources in the proportions they have.

    Null and empty texts are their end token alone; texts of any length are cut over sequences. Null ids stay null, null sources are
    a queue of their own, repeated rows are packed each. An empty table gives no pieces; columns besides those of documents do not matter.
    """
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express shingle sets and their links; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
