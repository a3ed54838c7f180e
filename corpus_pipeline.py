"""A corpus pipeline: documents to a mix, in five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm._io import materialize
from siltstone.llm.decontaminate import drop_leaks
from siltstone.llm.jaccard_join import drop_near_duplicates
from siltstone.llm.language_id import drop_unknown_languages, fit_language_model
from siltstone.llm.mixing import mix_blocks
from siltstone.llm.repetition import drop_repetitive


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the repetition rules. A null, empty or wordless text goes, a text of any length is measured
    whole, repeated rows go or stay together, an empty table stays empty; other columns, whatever their names, are
    carried and not read."""
    return drop_repetitive(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the input's labels teach: ``lang`` is only read to learn, and null labels teach nothing.
    A null or empty text, or one without a letter, goes, and so does text unlike all languages; where no row is
    labelled every lettered row stays. Of equally likely languages the first counts; repeated rows go or stay
    together, an empty table stays empty, other columns are carried."""
    return drop_unknown_languages(docs, fit_language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of 80 per cent of five-word shingles join, the one of the smallest
    doc_id, nulls last. Different texts under one id, or without one, are different documents; of rows equal in id
    and text any one stays. Wordless texts stay, an empty table stays empty, other columns are carried."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ``benchmark``. Null, empty and wordless texts stay, and so does all where the benchmark
    is empty; whole texts are searched, repeated rows go or stay together, other columns are carried."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: (shard, slot, source, doc_ids, n_words, text), packed blocks of text with the documents that each is
    made of. Texts without words give nothing, a null source is one of its own, repeated rows have places of their
    own, an empty table gives no blocks; columns but doc_id, text and source are not read."""
    return mix_blocks(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]
#: Language ID and SimHash search are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows are those of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
