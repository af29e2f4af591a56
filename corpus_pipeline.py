"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a
DataFrame; all but the last keep the columns of ``documents``. ORACLE_SQL is None: the fitted classifier
and the tokenizer cannot be expressed in SQL, so the stages are tested against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.llm import bpe, line_dedup, mixing, near_duplicates, quality
from footmark.llm.common import drop_staged, small_side, staged, table
from footmark.llm.queries import RANK_FILE, TARGETS, source_levels

#: Row numbers sent to every task at most; more are joined by shuffle.
MOST_SENT = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rules and the fitted model keep. Null and empty texts go: they have no words."""
    return quality.keep_rows(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without repeated line chunks and ``n_chars`` counted anew (null stays null)."""
    cut = line_dedup.remove_repeated(docs).drop("n_removed_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: its smallest id, so rows repeating id and words come out once.

    Groups are made of rows, so a null or repeated id does not stand for other rows that have it. A row with
    a null id stays only in groups without any id; texts without words are never grouped.
    """
    # The number must be the same in every scan.
    rows = staged(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "numbered")
    found = near_duplicates.near_duplicates(rows.select(F.col("number").alias("doc_id"), "row.text"))
    members = found.select(F.col("doc_id").alias("number"), "component_id").join(rows.select("number", "row.doc_id"), "number")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    first = members.groupBy("component_id").agg(F.min(order)["number"].alias("first"))
    # Few rows go and their numbers are small: the texts stay where they are.
    gone = staged(members.join(first, "component_id").where("number != first").select("number"), "gone")
    drop_staged(found)
    return rows.join(small_side(gone, MOST_SENT), "number", "left_anti").select("row.*")


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture by target weights, once for each epoch that takes them."""
    return mixing.mixed(docs, source_levels(), TARGETS).drop("epoch")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the bytes decoded from the ids."""
    return bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN,
                      ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near duplicates", near_copies),
    ("mixing", target_mixture),
    ("bpe", bpe_round_trip),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {}
