"""A training-data pipeline of five stages; part of ``quern.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it
as Parquet into the shared folder and reads it again for the next one. All but
the last give the columns of ``documents``.

1. quality rules: texts that the base rules or the compression bands reject go;
2. n-gram Jaccard join: of each group of near copies (five-word shingles,
   similarity 0.8 or more, linked over any number of steps) that with the
   smallest doc_id stays;
   (documents are told by id and text: rows of one id and other texts are documents
   of their own, rows without id are compared too);
3. benchmark decontamination: passages of test items are cut out, texts with
   more than half their words in such passages go;
4. mixing: sources are brought half the way to equal weights (in entropy) by
   repeating smaller ones, at most half as often again; no text is lost;
5. token ids: texts are encoded into a store of directly addressable codes; the
   result is what the store says of each text.

A null text is empty and goes in stage 1; a null source is a source; a row without id
is kept like any. Rows that repeat whole leave one in stage 2; of near copies with equal
ids the first by a hash of the text stays. Very long texts go through each stage as its
module says. Columns beyond those of ``documents``, whatever their names, go through
stages 1 to 4 unchanged. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, ngram_join, quality_rules, token_store
from quern.llm._io import stored
from quern.llm.queries import MIX


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, threshold=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, window=10, max_coverage=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.documents(spark, path)


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mix), ("token ids", token_ids)]

#: SQL can say neither zstandard nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
