"""Mix sources to target weights: hash-random keys, distributed prefix sums and exact budget cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleaveset.llm._prefix import unit
from cleaveset.llm._store import Store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size, group_rows), one row a source.

    A source gets its weight's share of ``share`` times all sizes, at most ``most`` times its own size; what a capped
    source leaves is shared by weight among the others until none is above. In order of cap over weight, a source is
    capped exactly if its cap is at most its share of what the capped ones before it leave.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))).withColumn("_cap", most * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))).alias("_others"),
    )
    capped = F.col("_cap") * F.col("_others") <= F.col("_left") * F.col("_w")
    level = F.max(F.when(~capped, F.col("_left") / F.col("_others"))).over(everything)
    levelled = left.select("source", "source_size", "group_rows", "_cap", "_w", capped.alias("_full"), level.alias("_level"))
    return levelled.select("source", "source_size", "group_rows", F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_level"))).alias("target"))


def plan_mix(rows: DataFrame, store: Store, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rows_per_bucket: int = 50_000) -> DataFrame:
    """One row a source: its size, target, whole passes and the place in its hash order at which the last pass ends.

    ``rows`` has (doc_id, source, size, _key). A source's uniform keys are cut into ranges of about ``rows_per_bucket``
    rows; prefix sums over the ranges' totals find the one in which the budget ends, and only that one is sorted.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("group_rows"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets(sizes, weights, share, most).select(
        F.col("source").alias("_source"), "source_size", "target", whole.alias("_whole"), (budget - whole * F.col("source_size")).alias("_rest"),
        F.greatest(F.lit(1.0), F.ceil(F.col("group_rows") / rows_per_bucket)).alias("_buckets"),
    )
    goal = store.keep(goal.coalesce(1), "targets")
    ranged = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", F.floor(unit(F.col("_key")) * F.col("_buckets")))
    totals = ranged.groupBy("_source", "_rest", "_bucket").agg(F.sum("size").alias("_total"))
    through = F.sum("_total").over(Window.partitionBy("_source").orderBy("_bucket"))
    ends = totals.withColumn("_through", through).where((F.col("_rest") < F.col("_through")) & (F.col("_rest") >= F.col("_through") - F.col("_total")))
    ends = store.keep(ends.select(F.col("_source").alias("_at"), F.col("_bucket").alias("_in"), (F.col("_through") - F.col("_total")).alias("_base")).coalesce(1), "ends")
    inside = ranged.join(ends, F.col("_source").eqNullSafe(F.col("_at")) & (F.col("_bucket") == F.col("_in")))
    ties = inside.groupBy("_source", "_rest", "_base", "_key", "doc_id", "size").agg(F.count("*").alias("_ties")).withColumn("_run", F.col("_ties") * F.col("size"))
    sofar = F.col("_base") + F.sum("_run").over(Window.partitionBy("_source").orderBy("_key", "doc_id", "size"))
    cut = ties.withColumn("_sofar", sofar).where((F.col("_rest") < F.col("_sofar")) & (F.col("_rest") >= F.col("_sofar") - F.col("_run")))
    cut = cut.select(F.col("_source").alias("_at"), F.struct("_key", "doc_id", "size").alias("_cut"), (F.col("_rest") - F.col("_sofar") + F.col("_run")).alias("_left"), "_ties")
    return store.keep(goal.join(cut, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at", "_rest", "_buckets").coalesce(1), "cuts")


def with_taken(rows: DataFrame, cuts: DataFrame, cut: str, most: float = 2.0) -> DataFrame:
    """Join each row with its source's cut, one row a source, and add ``taken``."""
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    here = F.struct("_key", "doc_id", "size")
    at = F.floor(F.col("_left") / F.col("_ties")) if cut == "word" else F.when(2 * F.col("_left") > F.col("_ties") * F.col("size"), F.col("size")).otherwise(F.lit(0))
    last = F.when(F.col("_cut").isNull(), F.lit(0)).when(here < F.col("_cut"), F.col("size")).when(here == F.col("_cut"), at).otherwise(F.lit(0))
    taken = F.least(F.col("_whole") * F.col("size") + last, F.floor(most * F.col("size"))).cast("long")
    return joined.withColumn("taken", taken)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> tuple:
    """Columns doc_id, source, size (words) and _key (hash-random order)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("_key")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, cut: str = "word", seed: int = 42, rows_per_bucket: int = 50_000) -> DataFrame:
    """How many words of each row the mix takes.

    Rows of a source are in the order of md5(id:seed), id, size. Whole passes over the source come first; the rest of
    the rounded target cuts the order at a running total of sizes. ``cut="word"`` takes of the row at the cut the words
    that meet the target exactly; ``cut="document"`` takes that row whole if over half of it is within.

    Null text or a text without words: size 0, taken 0. Null source: a source of its own, the last. Null id: the key is
    that of an empty string. Repeated rows of equal id and size are tied: at the cut they share what is left equally,
    rounded down (``document``: all or none of them). An empty table gives an empty result. Other columns are ignored.
    """
    if cut not in ("word", "document"):
        raise ValueError("cut must be word or document")
    store = Store(docs.sparkSession)
    rows = store.keep(docs.select(*sized(docs, id_col, text_col, source_col, seed)), "rows")
    cuts = plan_mix(rows, store, weights, share, most, rows_per_bucket)
    return with_taken(rows, cuts, cut, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 42, rows_per_bucket: int = 50_000) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of ``docs``, whatever their names.

    The row at a source's cut is taken whole if over half of it is within the budget. Null, empty and wordless texts have
    size 0 and go; a null source is a source of its own; repeated rows at the cut stay or go together; very long texts
    are only counted; an empty table gives an empty one.
    """
    store = Store(docs.sparkSession)
    rows = store.keep(docs.select(*sized(docs, seed=seed)), "rows")
    cuts = plan_mix(rows, store, rows_per_bucket=rows_per_bucket)
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("whole")
    own = docs.select(whole, *sized(docs, seed=seed))
    times = with_taken(own, cuts, "document").withColumn("times", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int"))
    return times.where("times > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select("whole.*")
