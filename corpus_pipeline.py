"""From raw documents to packed sequences: clean, deduplicated, sanitised, mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollframe.llm import jaccard, langid, mixing, packing, pii, toxicity
from rollframe.llm.common import row_key
from rollframe.llm.queries import tokenizer_file
from rollframe.plans.views import table
from rollframe.session import cut, forget

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; labels of ids whose crc32 modulo 3 is 1 are not learned from."""
    held_out = F.coalesce(langid.fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select(*COLUMNS), model, "_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (5-word shingles, similarity 0.8), that of the smallest id.

    Documents without words are no copies of each other; a repeated row stays once.
    """
    classes = jaccard.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = classes.where("set IS NOT NULL").groupBy("set").agg(first).select(F.col("first.row_key").alias("_kept"))
    kept = kept.unionByName(classes.where("set IS NULL").select(F.col("row_key").alias("_kept")).distinct())
    rows = docs.select(*COLUMNS, row_key("doc_id", F.coalesce("text", F.lit(""))).alias("_row"))
    rows = rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    once = F.row_number().over(W.partitionBy("_row").orderBy("lang", "source", "n_chars"))
    return rows.withColumn("_n", once).where("_n = 1").select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data named by its kind and the words that give it away left out."""
    found = pii.find_personal_data(docs, keep=("lang", "source"))
    text = pii.sanitised(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, always whole."""
    copies = mixing.mix_sources(docs).select("row_key", mixing.whole_copies().alias("n"))
    return mixing.repeat_to_mix(docs.select(*COLUMNS), copies)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("personal_data", remove_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: A tokenizer and learned weights can't be written as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if number:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
