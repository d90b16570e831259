import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.functions.numbers import rounded


def test_halves_are_rounded_as_in_sql(spark):
    x = [(2 * k + 1) / 2 / 1e6 + w for k in range(200) for w in (0.0, 32.0, 16.0)] + [-v / 2e6 for v in range(1, 99, 2)] + [0.0, 1e20, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x double")
    got = {r.id: r.y for r in df.select("id", rounded("x", 6).alias("y")).collect()}
    sql = duckdb.connect()
    sql.execute("CREATE TABLE t AS SELECT UNNEST($1) AS id, UNNEST($2)::DOUBLE AS x", [list(range(len(x))), x])
    want = dict(sql.execute("SELECT id, round(x, 6) FROM t").fetchall())
    assert got == want
    assert any(r.y != got[r.id] for r in df.select("id", F.round("x", 6).alias("y")).collect())


def test_word_counts_are_those_of_the_words_one_by_one(spark):
    rng = np.random.RandomState(1)
    fixed = ["", "e ee tree agree the able little fire eye aee ayee Lee ale ile lee", "Hello, WORLD! x9e e9x é été naïve file. a-e", None]
    texts = fixed + ["".join(rng.choice(list("aeiouybcldle .!?9é-E"), 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = ("letters", "words", "sentences", "syllables", "complex")
    counts = fn.word_counts(F.col("text"))
    for r in df.select("text", *(counts[n].alias(n) for n in names)).collect():
        if r.text is None:
            continue
        words = re.findall("[a-z]+", r.text.lower())
        each = [max(1, len(re.findall("[aeiouy]+", w)) - bool(re.search("[^l]e$", w))) for w in words]
        want = (len("".join(words)), len(words), max(1, len(re.findall("[.!?]+", r.text))), sum(each), sum(y >= 3 for y in each))
        assert tuple(r[n] for n in names) == want, r.text


def test_counts_are_computed_once_a_text(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = df.select(rounded(fn.readability(F.col("text"), "linsear_write"), 6).alias("grade"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3
