"""A corpus pipeline over ``documents``: language, site lines, near-duplicates,
benchmark passages, packing.  Each stage works on all rows its predecessor
kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontam, langid, linededup, packing, simhash
from runlens.llm.common import cut, read
from runlens.session import ship_package


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or null) go; the others get the
    predicted one as their ``lang``, by which they are packed."""
    ship_package(spark)
    return langid.accepted(docs, relabel=True)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a tenth of a source's documents are cut; every document
    stays."""
    return _sized(linededup.drop_site_lines(docs, "source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash the document of the least id stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are little else
    go."""
    ship_package(spark)
    return _sized(decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 1024, each of one
    language."""
    ship_package(spark)
    return packing.pack(docs, ids=False, by="lang")


STAGES = [("language ID", language), ("line dedup", site_lines), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark_passages), ("packing", packed)]
# Cross parsing, bit-sliced links and packing are not expressible in SQL; the
# pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and reread, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
