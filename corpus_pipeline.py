"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. What a stage returns is
written as Parquet and read again as the next one's ``docs``, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.bpe import digests, vocabulary_path
from demandspark.llm.common import read_table
from demandspark.llm.lines import dedup_lines
from demandspark.llm.mixing import mix_sources
from demandspark.llm.ngram_join import drop_near_duplicates
from demandspark.llm.quality import judge
from demandspark.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return judge(docs, read_table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; ``n_chars`` follows the text."""
    out = dedup_lines(docs, min_docs=10, keep="none")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the smallest id stays."""
    return drop_near_duplicates(docs, n=5, percent=80).select(*COLUMNS)


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    taken = mix_sources(docs).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return digests(docs, vocabulary_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near), ("mixing", mixing), ("bpe", tokens)]
#: Certified cutoffs and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
