"""From documents to token files: toxic documents go, one of each group of near copies stays,
documents that hold benchmark passages go, sources are mixed to target weights, and what is left is
encoded and written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet.

Defined cases, for all stages: columns beyond doc_id, text and source are kept whatever their names, up
to the token files; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmata.llm import binary, decontam, jaccard, mixing, tokenize, toxicity
from lemmata.session import ensure_importable, table

#: the mixture's target entropy, as a part of the most possible, and how often a source is used at
#: most; no document is left out, the largest source is used once
ENTROPY, REPEATS = 0.95, 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.3. Null and empty texts are scored like any (as without toxic words); repeated rows
    score alike, so all stay or go; documents with a null doc_id are scored and never learnt from."""
    return toxicity.drop_toxic(docs, table(ensure_importable(spark), sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: the one of least doc_id; of repeated rows one. Rows without words and rows
    with a null doc_id stay; unlike texts under one doc_id are judged each on its own."""
    ensure_importable(spark)
    return jaccard.keep_first(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item. Null, empty and wordless texts stay; repeated rows are judged alike."""
    return decontam.decontaminate(docs, table(ensure_importable(spark), sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, at least once. The null source is a source; documents without
    tokens are used once; repeated rows are used alike; a null doc_id is hashed as the empty string."""
    ensure_importable(spark)
    return mixing.apply_mix(docs, entropy=ENTROPY, repeats=REPEATS, fill=True)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document use: doc_id, start, n_tokens and ids_crc32, read back from the files, in ascending order of doc_id with
    null first. A null or empty text is the end id alone; repeated uses stand one after the other."""
    ensure_importable(spark)
    return binary.read_back(binary.write_ids(docs, tokenize.vocabulary_path(), end_id=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token-ID output", token_files),
]

#: the model and the tokenizer are not expressible in SQL; tests/llm/test_pipeline.py holds near duplicates, decontamination and token files
#: against brute force, and toxicity and mixing against the scores and uses that their operators give (tested on their own)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = binary.work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
