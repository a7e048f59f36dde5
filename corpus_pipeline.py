"""From raw documents to a weighted training mix: five stages, each a whole pass over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuspark.llm.common import table
from actuspark.llm.decontaminate import clean_only
from actuspark.llm.mixing import mixed
from actuspark.llm.nearcopies import keep_one
from actuspark.llm.queries import MIX, domain, mix_weights
from actuspark.llm.suffixes import repeated_spans
from actuspark.llm.toxicity import drop_toxic
from actuspark.session import materialize

#: Words from which a passage that repeats is cut out of all documents that hold it: passages of over 50 words.
REPEAT_WORDS = 51


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled ones among them, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 and more): the one with the smallest id."""
    return keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 51 words and more that also start elsewhere, whatever blanks lie between the words.

    ``text`` is what is left (characters that a cut splits go, too) and ``n_chars`` its length; a document of which nothing
    is left goes. Documents without such passages, empty and null ones among them, stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*others).alias("row"), "text", F.col("text").isNotNull().alias("known"))
    found = repeated_spans(held, "text", ("row", "known"), REPEAT_WORDS, keep_text=True, words=True)
    cut = F.col("n_removed") > 0
    found = found.where(~cut | (F.col("kept_text") != "")).withColumn(
        "row", F.when(cut, F.col("row").withField("n_chars", F.length("kept_text").cast("long"))).otherwise(F.col("row")))
    text = F.when(cut | F.col("known"), F.col("kept_text")).alias("text")
    return found.select("row.*", text).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items."""
    return clean_only(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each leaf of the domain / language / source tree delivers to the training mix."""
    return mixed(docs, mix_weights(spark), domain=domain(), **MIX)


STAGES = [("toxicity", without_toxic), ("simhash_dedup", without_copies), ("suffix_dedup", without_repeats),
          ("decontamination", without_benchmark), ("mixing", mix)]

ORACLE_SQL = None  # fitted weights, XXH64 fingerprints and byte-wise repeats have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
