"""A corpus from raw documents: identify languages, drop near duplicates, decontaminate, mix and shard.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again for the next one.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleaveset.llm import decontaminate, langid, mixing, ngram_join, sharding
from cleaveset.llm._store import Store
from cleaveset.session import prepare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; texts without letters and of no clear language go.

    Null, empty and letterless texts go. Very long texts are read whole. Repeated rows go or stay together; a null id or
    label only isn't learnt from. An empty table gives an empty one. Further columns are kept, whatever their names.
    """
    prepare(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by n-gram Jaccard similarity, the one of smallest id.

    Null, empty and wordless texts are linked with nothing and stay. Very long texts are compared whole. Of repeated rows
    one stays; rows of a null or repeated id are told apart by their texts. Pairs at the threshold link. An empty table
    gives an empty one. Further columns are kept, whatever their names.
    """
    prepare(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or paraphrased.

    Null and empty texts hold none and stay. Very long texts are searched whole. Repeated rows go or stay together. Null
    items hold nothing, repeated ones count once, items with a null id count. An empty table gives an empty one, an empty
    benchmark takes nothing. Further columns are kept, whatever their names.
    """
    prepare(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it.

    Null, empty and wordless texts have no size and go. A null source is a source of its own; a null id has the key of an
    empty one. Repeated rows at a source's cut stay or go together. Very long texts are counted whole. An empty table
    gives an empty one. Further columns are kept, whatever their names.
    """
    prepare(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, as the last result: doc_id, size, checksum, law, shard, slot.

    A null text has 16 bytes and checksum 0; a null id has the key of an empty string. Rows of one id, repeats of the mix
    among them, share a shard and take slots of their own. An empty table gives an empty one; further columns are ignored.
    """
    prepare(spark)
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages' classifier, latent space and checks are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(prepare(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return docs
