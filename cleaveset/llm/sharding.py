"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._prefix import before
from cleaveset.llm._store import Store

SHARDS = 40


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def scores(key: Column, weights: list[float]) -> Column:
    """An array of (score, -shard), one for each shard: weight / -ln(u) with u from md5(key:shard)."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    shard = F.sequence(F.lit(0), F.lit(len(weights) - 1))

    def one(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), s.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((F.element_at(w, s + 1) / -F.log(u)).alias("score"), (-s).alias("s"))

    return F.transform(shard, one)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, weights: list[float] | None = None, rows_per_bucket: int = 50_000) -> DataFrame:
    """Shard and slot of every row.

    A row goes to the shard with the largest rendezvous score of its key, so with one more shard rows move only into
    the new one. ``weights`` (default 1 for each) give a shard its expected share; the added shard weighs 1. Slots
    number the rows of a shard from 0 in the order of md5(key), key, size and text checksum.

    Null id: the key is the empty string. Null text: checksum 0 and 16 bytes. Rows with one id share a shard and take
    distinct slots. An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(key_of(id_col)).alias("_key"),
        scores(key_of(id_col), [*weights, 1.0]).alias("_scores"),
    )
    rows = rows.withColumn("_best", F.array_max(F.slice("_scores", 1, shards))).withColumn("_new", F.element_at("_scores", shards + 1))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "_key", (-F.col("_best.s")).cast("int").alias("shard"),
        F.when(F.col("_new.score") > F.col("_best.score"), F.lit(shards)).otherwise(-F.col("_best.s")).cast("int").alias("grown_shard"), F.lit(1).alias("_one"),
    )
    kept = Store(docs.sparkSession).keep(rows, "rows")
    stats = kept.groupBy("shard").agg(F.count("*").alias("group_rows"))
    placed = before(kept, ["shard"], "_key", ["doc_id", "size", "text_crc32"], "_one", "slot", F.broadcast(stats), rows_per_bucket)  # one row a shard
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
