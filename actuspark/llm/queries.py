"""The registered queries of the document operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuspark.llm import (convtrie, decontaminate, language, links, mixing, passages, periods, secretscan, simhash, sql,
                           suffixes, syncmers, tokencounts, toxicity)
from actuspark.llm.common import constants, table

Query = Callable[[SparkSession, str], DataFrame]

#: Half of all tokens, a leaf at most twice.
MIX = {"share": 0.5, "epochs": 2, "seed": 7}
WEIGHTS = [("domain", "d0", 2.0), ("domain", "d1", 1.0), ("domain", "d2", 1.0), ("language", "en", 4.0), ("language", "de", 2.0),
           ("language", "fr", 2.0), ("language", "es", 2.0), ("source", "src0", 3.0)]


def domain() -> Column:
    """The documents name no domain: sources are dealt to three by the first hexadecimal digits of their MD5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 4), 16, 10).cast("int")
    return F.concat(F.lit("d"), (digits % 3).cast("string"))


def mix_weights(spark: SparkSession) -> DataFrame:
    return constants(spark, WEIGHTS, {"level": pa.string(), "node": pa.string(), "weight": pa.float64()})


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"), threshold=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.filtered(table(spark, sf_dir, "pages"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.neighbours(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mix_weights(spark), domain=domain(), **MIX)


def recycled(docs: DataFrame) -> DataFrame:
    """Texts of documents whose crc32(doc_id) ends in 0, from word a on, repeat the p words from there; others stay as they are."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(crc / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((crc % 10 == 0) & (n > 0), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(recycled(table(spark, sf_dir, "documents")))
    best = F.array_sort("runs", lambda x, y: F.when(x.length * y.period != y.length * x.period, F.signum(
        (y.length * x.period - x.length * y.period).cast("double"))).when(x.start != y.start, F.signum((x.start - y.start).cast(
            "double"))).otherwise(F.signum((x.period - y.period).cast("double"))).cast("int"))
    best = F.get(best, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.secrets(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    base = [r.kind for r in secretscan.BASE]
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_language_id, op2_suffix_dedup, op3_url_filters, op4_token_counts, op5_substring_dedup,
                                    op6_toxicity, op7_simhash, op8_decontaminate, op9_syncmers, op10_mixing, op11_periodic_runs,
                                    op12_conversation_trie, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": sql.url_filters(URL_RULES), "op8_decontaminate": sql.DECONTAMINATE, "op10_mixing": sql.mixing(WEIGHTS, **MIX), "op11_periodic_runs": sql.PERIODIC_RUNS, "op12_conversation_trie": sql.CONVERSATION_TRIE, "op13_secret_scan": sql.SECRET_SCAN}
