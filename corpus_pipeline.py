"""The training-data pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all the rows that the stage before it kept. All but the last return the columns of
``documents``, with the values that came in, whatever an operator names its own columns. Rows without an id are never near-duplicates and lose nothing; rows that
repeat an id are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from corpuslake.llm import langid, minhash, packing, recompression  # noqa: E402
from corpuslake.llm.common import WORD  # noqa: E402
from corpuslake.session import keep  # noqa: E402


def _apart(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns that an operator would replace under other names, and how all columns get their names back."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in made}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those that decoding rejects go (no letter, letter junk, a language not learned, even mixtures). Only labelled rows that aren't held out train."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    renamed, own = _apart(docs, ["lang_pred", "score", "ambiguous", "rejected"])
    return langid.identify(renamed, model).where(~F.col("rejected")).select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of smallest doc_id."""
    return minhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a smaller doc_id has are cut; a cut text is its kept words joined by one space, others stay as they are."""
    renamed, own = _apart(docs, ["n_words", "n_removed", "kept_text"])
    cut = recompression.remove_repeats(renamed)
    lost = F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select([new.get(name, column) for name, column in zip(docs.columns, own)])


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document, with its length in words, which are the tokens of the batches' budget (counted in the JVM: a tokenizer's workers would stay beside those of other stages)."""
    counted = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    return packing.pack(keep(counted, "lengths"), "n_words")  # texts are read once


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing_plan)]

#: SQL expresses neither the classifier nor, so, what follows it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
