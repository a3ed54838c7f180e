"""Scans of articles, shards and question sets, and what their files say of themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.text import parsed_id

# The shapes of a shard's file name.
OF_SHARDS, NUMBERED = r"(\d{4,6})-of-(\d{4,6})", r"(?i)(?:shard|chunks|part)?[_-]?(\d+)"


def shard_id(name: Column, default: int = 0) -> Column:
    """A shard number from a file name: 00003-of-00041, else digits after shard, chunks or part."""
    first, second = F.regexp_extract(name, OF_SHARDS, 1), F.regexp_extract(name, NUMBERED, 1)
    return F.coalesce(F.when(first != "", first.cast("int")), F.when(second != "", second.try_cast("int")), F.lit(default))


def read_articles(spark: SparkSession, path: str, pattern: str = "*.parquet", unit_rows: int = 500) -> DataFrame:
    """(doc_id, title, url, text, categories, source_shard, unit) of the files under ``path``.

    An id comes from ``id`` or ``doc_id``, of any type; a row without one takes its place in its file. Text comes from
    ``text`` or ``content``. Nulls and columns that are not there are empty. A unit is a run of rows of a file.
    """
    raw = spark.read.option("pathGlobFilter", pattern).parquet(path)
    some = lambda *names: F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in raw.columns), F.lit(""))
    place = F.col("_metadata.row_index")
    unit = F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.floor(place / unit_rows).cast("string"), 6, "0"))
    none = F.array().cast("array<string>")
    categories = F.coalesce(F.col("categories"), none) if "categories" in raw.columns else none
    return raw.select(parsed_id(some("id", "doc_id"), place + 1).alias("doc_id"), some("title").alias("title"), some("url").alias("url"), some("text", "content").alias("text"), categories.alias("categories"), shard_id(F.col("_metadata.file_name")).alias("source_shard"), unit.alias("unit"))


def files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[str]:
    """The files under ``path`` by name; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    return sorted(r[0] for r in listed.collect())


def read_shards(spark: SparkSession, path: str, pattern: str = "chunks_*.parquet", max_shards: int | None = None) -> DataFrame:
    """The shards of a folder in the order of their names, the first ``max_shards`` where that is given."""
    return spark.read.parquet(*files(spark, path, pattern)[:max_shards])


def chunk_store(spark: SparkSession, path: str, shards: int = 2) -> DataFrame:
    """The first shards, kept in memory for lookups."""
    return read_shards(spark, path, max_shards=shards).cache()


def parquet_footers(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, rows, row_groups, packed_bytes, plain_bytes) of each file, from its footer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b["path"].to_pylist():
                fs, name = pafs.FileSystem.from_uri(p)
                meta = pq.ParquetFile(name, filesystem=fs).metadata
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                packed = sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns))
                out.append((p, meta.num_rows, len(groups), packed, sum(g.total_byte_size for g in groups)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)] if out else [pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4], names=["path", "rows", "row_groups", "packed_bytes", "plain_bytes"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInArrow(run, "path string, rows long, row_groups long, packed_bytes long, plain_bytes long")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of whole files; a file must fit a row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows in file order."""
    return spark.read.parquet(path).withColumn("__at", F.struct("_metadata.file_path", "_metadata.row_index")).orderBy("__at").limit(n).drop("__at")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, answers, aliases, titles) from a question set in JSON lines: query_id, id or ``q_`` and the
    line's number from 0; answer or answers, one or a list; blank lines count but give nothing. A file is a row while
    its lines are numbered."""
    text = F.lit("query_id string, id string, question string, answers string, answer string, aliases array<string>, entity_titles array<string>, titles array<string>")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("line", "json")).where(F.trim("json") != "")
    r = lines.select("line", F.from_json("json", text).alias("r")).select("line", "r.*")
    filled = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "[]"), F.col(c))
    listed = F.coalesce(filled("answer"), filled("answers"))
    answers = F.when(listed.isNull(), F.array().cast("array<string>")).when(listed.startswith("["), F.from_json(listed, "array<string>")).otherwise(F.array(listed))
    none = F.array().cast("array<string>")
    return r.select(F.coalesce("query_id", "id", F.concat(F.lit("q_"), F.col("line").cast("string"))).alias("query_id"), F.coalesce("question", F.lit("")).alias("question"), answers.alias("answers"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("entity_titles", "titles", none).alias("titles"))
