"""P11 on a stored index: symbols with their parents, kept so that a lookup by
name reads the few row groups that can hold it.

The index is Parquet, one folder a bucket of names, sorted by name, in small row
groups with a Bloom filter of names each.  A lookup of a few names is a filter
that Spark pushes into the scan: folders are pruned by the buckets of the names,
row groups by their statistics and Bloom filters.  A lookup of a table of names
first asks which buckets it needs, of which there are few, and joins the folders
of those on (bucket, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.symbols import with_parents

BUCKETS, ROW_GROUP_BYTES = 32, 1 << 20
MEMBERS = ("fields", "methods")


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def index_entries(spans: DataFrame, rule: str = "python") -> DataFrame:
    """(identifier, entry_type, file_path, start_line, end_line, parent_class,
    parent_function, fields, methods) of all symbols: classes, functions
    without and with (``class_method``) a parent class."""
    none = F.lit(None).cast("string")
    kind = F.col("kind")
    if rule == "none":
        rows = spans.select("*", none.alias("parent_function"), none.alias("parent_class"))
    else:
        rows = with_parents(spans, rule)
    entry = (F.when(kind == "class", "class").when(F.col("parent_class").isNull(), "function").otherwise("class_method"))
    whole = F.col("file_path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull() | F.lit(rule == "none")
    return rows.where((kind == "class") | ((kind == "function") & whole)).select(
        F.col("name").alias("identifier"), entry.alias("entry_type"), "file_path", "start_line", "end_line", "parent_class", "parent_function",
        *[(F.when(kind == "class", F.col(m)) if m in spans.columns else none).alias(m) for m in MEMBERS])


def write_index(spans: DataFrame, path: str, rule: str = "python", buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Derive every symbol's parents once and store them under ``path``.  Rows
    are dealt by ranges of (bucket, name, file), so a name that very many files
    have goes over several tasks and files, each sorted by name."""
    rows = index_entries(spans, rule).withColumn("bucket", bucket_of(F.col("identifier"), buckets))
    (rows.repartitionByRange("bucket", "identifier", "file_path").sortWithinPartitions("bucket", "identifier", "entry_type", "file_path", "start_line")
     .write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", row_group_bytes).option("maxRecordsPerFile", 1_000_000)
     .option("parquet.bloom.filter.enabled#identifier", "true").option("parquet.bloom.filter.expected.ndv#identifier", 20_000).parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _buckets(names: DataFrame, buckets: int) -> list[int]:
    """The buckets of (identifier): at most ``buckets`` numbers."""
    return [r["b"] for r in names.select(bucket_of(F.col("identifier"), buckets).alias("b")).distinct().collect() if r["b"] is not None]


def lookup_names(spark: SparkSession, path: str, names: list[str], entry_type: str, buckets: int = BUCKETS) -> DataFrame:
    """The entries of a few names and one type, by pushed filters alone."""
    wanted = _buckets(spark.createDataFrame([(n,) for n in names], "identifier string"), buckets)
    index = read_index(spark, path)
    return index.where(F.col("bucket").isin(wanted) & F.col("identifier").isin(list(names)) & (F.col("entry_type") == entry_type)).drop("bucket")


def lookup(spark: SparkSession, path: str, lookups: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """:func:`runlens.operators.symbols.symbol_lookup` of a table of
    (identifier, entry_type) from the stored index."""
    asked = lookups.withColumn("bucket", bucket_of(F.col("identifier"), buckets))
    index = read_index(spark, path).where(F.col("bucket").isin(_buckets(lookups, buckets)))
    return asked.join(index, ["bucket", "identifier", "entry_type"]).select(
        *lookups.columns, "file_path", "start_line", "end_line", "parent_class", *MEMBERS)
