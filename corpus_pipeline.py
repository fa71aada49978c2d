"""A corpus pipeline over ``documents``: each stage calls one operator of ``weftline.llm``.

Every function takes ``(spark, docs, sf_dir)``. All stages but the last return the columns of
``documents``; what a stage removes is gone for the next. A stage's result is written before the
next one starts, which therefore removes what the last has left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import cut, noting, release, scratch_path, settle
from weftline.llm import decontam, lines, pieces, quality, simhash
from weftline.llm.text import unused


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _releasing(stage: Stage) -> Stage:
    """Remove the scratch tables of the stage before and note those of this one."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with noting() as paths:
            out = stage(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@_releasing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds of their language and source.

    Null and empty texts have no words and go. Rows stay as they are, repeated ones as often as
    they occur; null languages and sources are groups of their own.
    """
    return quality.quality(docs, with_rows=True).where("kept").select("row.*")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of id and text hash, which tells rows apart that share an id, and its name."""
    (key,) = unused(docs, "key")
    return docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("text"))), key


@_releasing
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, or nearly, however short.

    Rows that share an id are told apart by their text, so none loses a line that goes in another;
    rows that share both stay or lose lines alike. A text may end up empty, its row stays. Null
    texts stay null, null ids come first, empty lines stay; ties are broken by id, then line.
    """
    keyed, key = _keyed(docs)
    left = lines.without_lines(keyed, lines.removed_lines(keyed, key, least_words=1), key).drop(key)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_releasing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies by SimHash, unless an earlier one of these has at least 0.8 of its shingles.

    Fingerprints within four bits settle close copies; what they leave is compared by an exact
    join of the sets of five-word shingles. Rows are ordered by id, null first; those that share
    an id are told apart by their text, and of those that share both one stays: the smallest by
    all columns. Texts without words (null, empty) are copies of each other.
    """
    keyed, key = _keyed(docs)
    told = simhash.near_duplicates(keyed, id_col=key)
    first = cut(told.where(F.col("id") == F.col("component")).groupBy(F.col("id").alias(key)).agg(F.count("*").alias("rows")))
    sets = settle(simhash.shingle_sets(keyed.join(first.select(key), key, "left_semi"), id_col=key), "shingles")
    gone = lines.removed_lines(sets, "id", least_words=1).where(F.size("removed") > 0).select(F.col("id").alias(key))
    kept = cut(first.join(gone, key, "left_anti"))
    once = keyed.join(kept.where("rows = 1").select(key), key, "left_semi").select(*docs.columns)
    more = keyed.join(kept.where("rows > 1").select(key), key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(more.select("row.*"))


@_releasing
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none, repeated rows are judged alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (found,) = unused(docs, "found")
    return decontam.overlaps(spark, docs, benchmark, found_col=found).where(F.size(found) == 0).drop(found)


@_releasing
def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each document and digests of its ids and of the text they decode to, one row per row; null texts are empty."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(spark, docs, model).drop("text")
    told = pieces.token_digests(pieces.decode(spark, ids, model))
    return told.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokenization),
]

#: Tokenization is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``; each result is written before the next reads it, and removed after."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            release(spark, before)
            before.append(path)
    return docs
