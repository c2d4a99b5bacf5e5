"""From raw documents to packed training sequences.

Quality rules, SimHash near-dedup, substring dedup, mixing sources to target weights and
best-fit packing, each on all that the stage before kept. All stages but the last return the
columns of documents, whatever else these are called: operators only see what they need, the rest of
a row travels packed. Repeated rows, nulls and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common, mixing, neardup, packing, quality, substring


def packed(docs: DataFrame, *own: Column | str) -> DataFrame:
    """docs as one column `row` without the text, beside the columns `own`."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), *own)


def replaced(df: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of `like` from `row`, with the text from another column and its length to match."""
    columns = []
    for c in like.columns:
        if c == "text":
            columns.append(F.col(text).alias("text"))
        elif c == "n_chars":
            columns.append(F.length(text).cast(like.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return df.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without lines that too many documents of their source have."""
    judged = quality.judge(packed(docs, "doc_id", "source", "text"), "source", "text").where("kept")
    return replaced(judged, docs, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: that with the smallest doc_id."""
    return neardup.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; a text left without a word goes."""
    cut = substring.drop_repeats(packed(docs, "doc_id", "text"), layout=True)
    return replaced(cut.where("n_removed < n_words"), docs, "kept_text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the order of the mix."""
    mixed = mixing.mix(packed(docs, "doc_id", "source", "text"), common.word_count(F.col("text")), F.col("source"), [F.col("doc_id"), common.text_hash("text")])
    return replaced(mixing.in_order(mixed), docs, "text")


def to_pack(docs: DataFrame) -> DataFrame:
    """The columns of a document that packing sees."""
    return docs.select("doc_id", common.word_count(F.col("text")).alias("n_words"), common.text_hash("text").alias("h"), "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, as word ranges of documents; no sequence has a document twice."""
    return packing.pack(to_pack(docs).drop("text"), F.col("n_words"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, shuffles by hash and packing can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir after all stages but packing, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES[:-1]):
        docs = common.stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir: sequences as word ranges of documents."""
    return pack_sequences(spark, mixed(spark, sf_dir), sf_dir)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `run` gives, with the texts of each sequence's items as the stages before have left them."""
    docs = mixed(spark, sf_dir)
    bins = common.stage(pack_sequences(spark, docs, sf_dir), "pipeline-bins")
    return packing.with_texts(bins, to_pack(docs))
