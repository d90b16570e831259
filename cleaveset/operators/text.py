"""Text scorers: each returns (id, score, pos) and, where the order is of the items themselves, the item."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.functions.numbers import rounded
from cleaveset.operators.ranking import rank_by
from cleaveset.store import Store

DIGITS = 6
#: Words that are broadcast with their frequencies; the others are joined by shuffle.
COMMON = 50_000


def score_sorter(df: DataFrame, score: Column, id_col: str = "id", low_first: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rank by any score expression, ties by id."""
    scored = df.select(F.col(id_col).alias("id"), score.alias("score"), *keep)
    return rank_by(scored, "score", "id", low_first).select("id", "score", "pos", *keep)


def character_length(df: DataFrame, text_col: str = "text", id_col: str = "id", short_first: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    return score_sorter(df, F.length(text_col), id_col, short_first, keep)


def tokens_length(df: DataFrame, text_col: str = "text", id_col: str = "id", short_first: bool = True, tokenizer=fn.simple_tokenizer) -> DataFrame:
    return score_sorter(df, F.when(F.col(text_col).isNotNull(), F.size(tokenizer(F.col(text_col)))), id_col, short_first)


def sentence_count(df: DataFrame, text_col: str = "text", language: str = "en", id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Segments of the JVM's rule-based sentence breaker for the language."""
    return score_sorter(df, F.when(F.col(text_col).isNotNull(), F.size(F.sentences(F.col(text_col), F.lit(language), F.lit("")))), id_col, low_first)


def lexical_diversity(df: DataFrame, text_col: str = "text", id_col: str = "id", low_first: bool = True, tokenizer=fn.simple_tokenizer) -> DataFrame:
    """Distinct over all tokens, case-sensitive; 0 without tokens."""
    tokens = tokenizer(F.col(text_col))
    return score_sorter(df, rounded(F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0), DIGITS), id_col, low_first)


def corpus_frequencies(df: DataFrame, text_col: str = "text", tokenizer=fn.simple_tokenizer) -> DataFrame:
    """(word, frequency) of the corpus itself, where no outside table is given."""
    words = df.select(F.explode(tokenizer(F.lower(text_col))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("word", (F.col("n") / F.col("_all")).alias("frequency"))


def vocabulary_rarity(df: DataFrame, frequencies: DataFrame, text_col: str = "text", id_col: str = "id", low_first: bool = True, tokenizer=fn.simple_tokenizer) -> DataFrame:
    """Mean over lower-cased tokens of 1 - frequency; an unknown word has rarity 1, a text without tokens scores 0.

    The commonest words meet their tokens where these are; only tokens of other words are shuffled.
    """
    frequencies = Store(df.sparkSession).keep(frequencies.select("word", "frequency"), "frequencies")
    common = frequencies.orderBy(F.col("frequency").desc(), "word").limit(COMMON)
    words = df.select(F.col(id_col).alias("id"), F.explode(tokenizer(F.lower(text_col))).alias("word"))
    joined = words.join(F.broadcast(common), "word", "left")  # COMMON rows at most
    known = joined.where("frequency IS NOT NULL").select("id", (1 - F.col("frequency")).alias("r"))
    others = joined.where("frequency IS NULL").select("id", "word").join(frequencies, "word", "left")
    each = known.unionByName(others.select("id", (1 - F.coalesce("frequency", F.lit(0.0))).alias("r")))
    means = each.groupBy("id").agg((F.sum("r") / F.count("*")).alias("_m"))
    scored = df.select(F.col(id_col).alias("id")).join(means, "id", "left")
    return score_sorter(scored, rounded(F.coalesce("_m", F.lit(0.0)), DIGITS), "id", low_first)


def readability_score(df: DataFrame, metric: str = "flesch_kincaid", text_col: str = "text", id_col: str = "id", low_first: bool = True, min_words: int = 100, easy_words: list[str] | None = None) -> DataFrame:
    return score_sorter(df, rounded(fn.readability(F.col(text_col), metric, min_words, easy_words), DIGITS), id_col, low_first)


def perplexity_score(df: DataFrame, loss, text_col: str = "text", id_col: str = "id", low_first: bool = True) -> DataFrame:
    """exp(mean token loss) of an injected model: ``loss`` maps a text to its token losses; under two tokens, infinity."""
    @F.pandas_udf("double")
    def perplexity(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [] if t is None else list(loss(t))
            out.append(math.exp(sum(found) / len(found)) if found else float("inf"))
        return pd.Series(out, dtype="float64")

    return score_sorter(df, perplexity(F.col(text_col)), id_col, low_first)


def bigram_perplexity(df: DataFrame, text_col: str = "text", id_col: str = "id", low_first: bool = True, tokenizer=fn.simple_tokenizer) -> DataFrame:
    """Perplexity under the corpus's own add-one bigram model, by joins: an offline stand-in for a neural model's."""
    tokens = df.select(F.col(id_col).alias("id"), tokenizer(F.lower(text_col)).alias("t")).where(F.size("t") >= 2)
    pairs = tokens.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("a"), F.element_at("t", i + 1).alias("b")))).alias("p")).select("id", "p.a", "p.b")
    own = pairs.groupBy("id", "a", "b").agg(F.count("*").alias("k"))
    both = own.groupBy("a", "b").agg(F.sum("k").alias("n"))
    first = both.groupBy("a").agg(F.sum("n").alias("na"))
    size = tokens.select(F.explode("t").alias("w")).agg(F.countDistinct("w").alias("v"))
    loss = own.join(both, ["a", "b"]).join(first, "a").join(F.broadcast(size)).groupBy("id").agg((-F.sum(F.col("k") * F.log((F.col("n") + 1) / (F.col("na") + F.col("v")))) / F.sum("k")).alias("_l"))
    scored = df.select(F.col(id_col).alias("id")).join(loss, "id", "left")
    return score_sorter(scored, rounded(F.coalesce(F.exp("_l"), F.lit(float("inf"))), DIGITS), "id", low_first)


def diversity_text(df: DataFrame, text_col: str = "text", id_col: str = "id", n: int = 3, block_rows: int = 512) -> DataFrame:
    """Mean n-gram Jaccard distance over all ordered pairs, self-pairs included.

    Rows are hashed to blocks, and each pair of blocks is one task that returns a sum, so pairs are never rows.
    """
    rows = df.select(fn.simple_tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.xxhash64(F.col(id_col)).alias("h"))
    blocks = max(1, -(-df.count() // block_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = F.pmod("h", F.lit(blocks)).cast("int")
    left = rows.select("t", own.alias("i"), every.alias("j"))
    right = rows.select("t", every.alias("i"), own.alias("j"))

    def total(a: pa.Table, b: pa.Table) -> pa.Table:
        def grams(table):
            return [[{tuple(t[k : k + m]) for k in range(len(t) - m + 1)} for m in range(1, n + 1)] for t in table["t"].to_pylist()]

        x, y = grams(a), grams(b)
        out = 0.0
        for u in x:
            for v in y:
                out += 1 - sum(len(p & q) / len(p | q) if p or q else 0.0 for p, q in zip(u, v)) / n
        return pa.table({"s": pa.array([out]), "n": pa.array([len(x) * len(y)])})

    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(total, "s double, n long")
    return sums.agg(rounded(F.sum("s") / F.sum("n"), DIGITS).alias("diversity"))
