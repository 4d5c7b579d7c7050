"""A training corpus from raw documents: five stages, each a written table that the next one reads.

Each stage works on all rows that the one before it kept. The first four return the columns of ``documents``, the last one the pieces of
packed sequences. Columns named like those used inside are kept as they are, and empty tables stay empty. A stage's intermediate tables are
deleted when the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.llm import decontam, packing, similar, suffixes, toxicity
from flowgate.llm.common import table
from flowgate.staging import links_of_a_chain, stage


@links_of_a_chain
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null, empty and wordless texts have no toxic passage and stay; equal texts share their fate; a null id is never learnt from.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@links_of_a_chain
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are five-word similarities of 0.8 or more, which four bits of ``op7_simhash`` do not reach.

    Null, empty and wordless texts are one component. The smallest id stays, null ids last; of repeated rows one.
    """
    return similar.keep_one(docs)


@links_of_a_chain
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that occur more than once are cut out; every document stays, and its length is counted anew.

    Null texts stay null (their length too); a text that is repeated as a whole becomes empty. Repeated rows lose the same strings.
    """
    return suffixes.remove_repeats(docs, rules=(suffixes.LONG_STRINGS, suffixes.PASSAGES)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@links_of_a_chain
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null, empty and wordless texts have none and stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@links_of_a_chain
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences. A null or empty text is the end token alone; repeated rows are packed each."""
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

# Models, fingerprints and packing are not SQL; tests/llm compares each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
