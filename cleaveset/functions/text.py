"""Text functions as column expressions; pandas UDFs only for the sequence matcher, which has no expression."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def simple_tokenizer(text: Column) -> Column:
    """Tokens between runs of Unicode white space, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams as strings, joined by a character that tokens don't hold."""
    if n <= 0:
        raise ValueError("n must be positive")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))


def ngram_jaccard_similarity(a: Column, b: Column, n: int = 3, tokenizer=simple_tokenizer) -> Column:
    """Mean over i = 1..n of the Jaccard similarity of the sets of i-grams; an empty union counts as 0."""
    x, y = tokenizer(a), tokenizer(b)
    total = F.lit(0.0)
    for i in range(1, n + 1):
        u, v = ngrams(x, i), ngrams(y, i)
        total = total + F.coalesce(F.size(F.array_intersect(u, v)) / F.nullif(F.size(F.array_union(u, v)), F.lit(0)), F.lit(0.0))
    return total / n


def ngram_jaccard_distance(a: Column, b: Column, n: int = 3, tokenizer=simple_tokenizer) -> Column:
    return 1 - ngram_jaccard_similarity(a, b, n, tokenizer)


@F.pandas_udf(T.DoubleType())
def difflib_character_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the characters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b)], dtype="float64")


def difflib_token_similarity(a: Column, b: Column, tokenizer=simple_tokenizer) -> Column:
    """The same ratio over tokens."""
    return _token_similarity(tokenizer(a), tokenizer(b))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def word_counts(text: Column) -> dict[str, Column]:
    """Letters, words, sentences, syllables and long words of a text, by regular expressions (English rules).

    A word's syllables are its runs of vowels, without a last one that ends in a silent e, and one at least. Passes over
    the whole text replace the silent runs by a consonant and the others by one letter each, so words needn't be parted.
    """
    low = F.lower(text)
    count = lambda t, pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).cast("double")
    runs = F.regexp_replace(F.regexp_replace(low, "(?:[aeiouy]+e|(?<=[bcdfghjkmnpqrstvwxz])e)(?![a-z])", "b"), "[aeiouy]+", "a")
    marks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("a"), F.lit("")))).cast("double")
    return {
        "letters": F.length(F.regexp_replace(low, "[^a-z]+", "")).cast("double"),
        "words": count(low, "[a-z]+"),
        "sentences": F.greatest(F.lit(1.0), count(text, "[.!?]+")),
        "syllables": let(runs, lambda t: marks(t) + count(t, "(?<![a-z])[b-z]++(?![a-z])")),
        "complex": count(runs, "(?<![a-z])(?:[b-z]*+a){3}[a-z]*+"),
        "tokens": F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)),
    }


READABILITY = ("flesch_kincaid", "flesch", "gunning_fog", "coleman_liau", "dale_chall", "ari", "linsear_write", "smog")


def readability(text: Column, metric: str = "flesch_kincaid", min_words: int = 100, easy_words: list[str] | None = None) -> Column:
    """A readability grade; infinity where the text is too short for it (``smog`` needs 30 sentences, too)."""
    if metric not in READABILITY:
        raise ValueError(f"Unknown readability metric: {metric}")
    counts = word_counts(text)
    if metric == "dale_chall":
        if not easy_words:
            raise ValueError("dale_chall needs its list of easy words")
        hard = let(counts["tokens"], lambda t: F.struct(F.size(t).cast("double").alias("words"), F.size(F.filter(t, lambda w: ~w.isin(list(easy_words)))).alias("difficult")))
        return let(F.struct(hard.alias("c"), counts["sentences"].alias("sentences")), lambda v: _dale_chall(v["c"]["words"], v["sentences"], v["c"]["difficult"], min_words))
    need = {"flesch_kincaid": ("syllables",), "flesch": ("syllables",), "coleman_liau": ("letters",), "ari": ("letters",)}.get(metric, ("complex",))
    return let(F.struct(*(counts[c].alias(c) for c in ("words", "sentences", *need))), lambda c: _grade(metric, c, min_words))


def _dale_chall(w: Column, s: Column, difficult: Column, min_words: int) -> Column:
    share = difficult / w * 100
    value = 0.1579 * share + 0.0496 * (w / s) + F.when(share > 5, 3.6365).otherwise(0.0)
    return F.when(w >= min_words, value).otherwise(F.lit(float("inf")))


def _grade(metric: str, c: Column, min_words: int) -> Column:
    w, s, y, letters, hard = (c[x] for x in ("words", "sentences", "syllables", "letters", "complex"))
    enough = w >= min_words
    if metric == "flesch_kincaid":
        value = 0.39 * (w / s) + 11.8 * (y / w) - 15.59
    elif metric == "flesch":
        value = 206.835 - 1.015 * (w / s) - 84.6 * (y / w)
    elif metric == "gunning_fog":
        value = 0.4 * (w / s + 100 * (hard / w))
    elif metric == "coleman_liau":
        value = 0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8
    elif metric == "ari":
        value = 4.71 * (letters / w) + 0.5 * (w / s) - 21.43
    elif metric == "smog":
        value = 1.043 * F.sqrt(30 * (hard / s)) + 3.1291
        enough = enough & (s >= 30)
    else:
        raw = ((w - hard) + 3 * hard) / s
        value = F.when(raw > 20, raw / 2).otherwise((raw - 2) / 2)
    return F.when(enough, value).otherwise(F.lit(float("inf")))
