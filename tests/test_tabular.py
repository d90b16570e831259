import math

import pytest

from cleaveset.operators import embedding, ranking, tabular
from cleaveset.operators.ranking import rank_by, with_before


def order(df):
    return [r.id for r in sorted(df.collect(), key=lambda r: r.pos)]


def scores(df):
    return {r.id: r.score for r in df.collect()}


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(0, 30, "c"), (1, 10, "a"), (2, 20, "b")], "id int, value int, name string")


def test_column_value(spark, values):
    assert order(tabular.column_value(values, "value")) == [1, 2, 0]
    assert order(tabular.column_value(values, "value", low_first=False)) == [0, 2, 1]
    assert order(tabular.column_value(values, "name")) == [1, 2, 0]
    gaps = spark.createDataFrame([(0, 20.0), (1, None), (2, 10.0), (3, float("nan"))], "id int, value double")
    assert order(tabular.column_value(gaps, "value")) == [2, 0, 1, 3]
    assert order(tabular.column_value(gaps, "value", low_first=False)) == [0, 2, 1, 3]


def test_column_rank(spark):
    df = spark.createDataFrame([(0, 100), (1, 50), (2, 75), (3, 25)], "id int, value int")
    assert scores(tabular.column_rank(df, "value")) == {0: 100, 1: 50, 2: 75, 3: 25}
    ties = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, None), (3, 1.0), (4, None)], "id int, value double")
    assert scores(tabular.column_rank(ties, "value")) == {0: 60, 1: 30, 2: 90, 3: 30, 4: 90}


def test_zscore(spark):
    df = spark.createDataFrame([(0, 20), (1, 50), (2, 80)], "id int, value int")
    assert order(tabular.column_zscore(df, "value")) == [0, 1, 2]
    assert order(tabular.column_zscore(df, "value", absolute=True))[0] == 1
    flat = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "id int, value int")
    assert scores(tabular.column_zscore(flat, "value")) == {0: 0, 1: 0, 2: 0}
    gap = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "id int, value double")
    assert scores(tabular.column_zscore(gap, "value"))[1] == math.inf
    assert order(tabular.column_zscore(gap, "value", low_first=False))[0] == 1


def test_missing_and_sparse(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3), (1, None, 2.0, 3), (2, None, None, 3)], "id int, a double, b double, c int")
    assert scores(tabular.missing_value_ratio(df)) == pytest.approx({0: 0, 1: 1 / 3, 2: 2 / 3}, abs=1e-6)
    df = spark.createDataFrame([(0, 1, 2, 3), (1, 0, 0, 1), (2, 0, 0, 0)], "id int, a int, b int, c int")
    assert scores(tabular.row_sparsity(df)) == pytest.approx({0: 0, 1: 2 / 3, 2: 1}, abs=1e-6)


def test_outliers(spark):
    df = spark.createDataFrame([(0, 48, 49), (1, 52, 51), (2, 50, 50), (3, 51, 52), (4, 1000, 1000)], "id int, a int, b int")
    assert order(tabular.outlier_zscore(df))[-1] == 4
    vectors = df.selectExpr("id", "array(cast(a as double), cast(b as double)) AS e")
    assert order(embedding.outlier_score(vectors))[-1] == 4
    assert order(embedding.outlier_score(vectors, "lof", k=2))[-1] == 4
    with pytest.raises(ValueError):
        embedding.outlier_score(vectors, "unknown")


def test_mixed_rows(spark):
    df = spark.createDataFrame([(0, 50, 50), (1, 0, 0), (2, 100, 100)], "id int, a int, b int")
    assert scores(tabular.row_distance_to_mean(df))[0] == 0
    ranges = scores(tabular.numerical_range_score(df))
    assert ranges[0] == pytest.approx(50 / 3, abs=1e-5) and ranges[2] == 50
    weights = spark.createDataFrame([(0, 0, 100), (1, 50, 50), (2, 100, 0)], "id int, a int, b int")
    assert set(scores(tabular.multi_column_sort(weights, ["a", "b"])).values()) == {1.0}
    assert order(tabular.multi_column_sort(weights, ["a", "b"], [1, -1])) == [0, 1, 2]
    with pytest.raises(ValueError):
        tabular.multi_column_sort(weights, ["a", "b"], [1])


def test_categories(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, None)], "id int, category string")
    found = scores(tabular.categorical_rarity(df, "category"))
    assert found == pytest.approx({0: 0.6, 1: 0.6, 2: 0.6, 3: 0.2, 4: 0.2, 5: 0})
    assert order(tabular.categorical_rarity(df, "category")) == [0, 1, 2, 3, 4, 5]
    two = spark.createDataFrame([(0, "A", "X"), (1, "A", "X"), (2, "A", "Y"), (3, "B", "Z")], "id int, cat1 string, cat2 string")
    e = scores(tabular.feature_entropy(two))
    assert e[0] == e[1] < e[3]


def test_empty_and_string_ids(spark):
    empty = spark.createDataFrame([], "id int, a double, b double")
    for found in (tabular.column_value(empty, "a"), tabular.column_rank(empty, "a"), tabular.column_zscore(empty, "a"), tabular.missing_value_ratio(empty), tabular.row_sparsity(empty), tabular.outlier_zscore(empty), tabular.row_distance_to_mean(empty)):
        assert found.collect() == []
    named = spark.createDataFrame([("x", 30), ("y", 10), ("z", 20)], "id string, value int")
    assert order(tabular.column_value(named, "value")) == ["y", "z", "x"]


@pytest.mark.parametrize("rows_of_a_range", [250_000, 130])
def test_rank_is_a_total_order_with_ties_and_skew(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ranking, "ROWS", rows_of_a_range)
    rows = [(i, None if i % 11 == 0 else 7.0 if i % 3 else float(i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, score double")
    for low in (True, False):
        want = sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if low else -1), r[0]))
        got = {r.id: r.pos for r in rank_by(df, low_first=low).collect()}
        assert [got[i] for i, _ in want] == list(range(1, 2001))
    weighted = {r.id: r["_before"] for r in with_before(df, "score", "id", weight=df.id).collect()}
    total = 0
    for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        assert weighted[i] == total
        total += i


def test_ranges_cut_texts_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 50)
    rows = [(f"id{i:04d}", None if i % 17 == 0 else "https://example.org/" + "ab"[i % 2] * (i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, score string").repartition(5)
    for low in (True, False):
        want = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
        want = sorted(want, key=lambda r: r[1], reverse=not low) + sorted(r for r in rows if r[1] is None)
        got = {r.id: r.pos for r in rank_by(df, low_first=low).collect()}
        assert [got[i] for i, _ in want] == list(range(1, 601))
    cut = ranking.cut_groups(df.selectExpr("id", "if(score is null, 'x', 'y') AS g"), "g", 0.7)
    train = [(r.g, r.split) for r in cut.collect()]
    assert train.count(("x", "train")) == int(36 * 0.7) and train.count(("y", "train")) == int(564 * 0.7)
    assert ranking.quantiles(spark.range(200), ranking.column("id"), [0.0, 0.33, 0.5, 1.0]) == pytest.approx([0, 0.33 * 199, 99.5, 199])
    ranks = {r["_v"]: r.r for r in ranking.average_rank(spark.range(200).selectExpr("id % 2 AS v"), "v", "r").collect()}
    assert ranks == {0: 50.5, 1: 150.5}


def test_no_internal_column_clashes(spark):
    names = ["_b", "_s", "_p", "_w", "_m", "_n", "_cuts", "k0", "row", "before", "b", "m", "w", "a.b", "pos_"]
    df = spark.createDataFrame([(i, float(i), *[i * 10 + k for k in range(len(names))]) for i in range(4)], ["id", "score", *names])
    for low in (True, False):
        ranked = rank_by(df, low_first=low)
        assert ranked.columns == [*df.columns, "pos"]
        assert {tuple(r[2:-1]) for r in ranked.collect()} == {tuple(i * 10 + k for k in range(len(names))) for i in range(4)}
    for c in names:
        assert len(tabular.column_zscore(df, c).collect()) == len(tabular.column_rank(df, c).collect()) == len(tabular.column_value(df, c).collect()) == 4
    for found in (tabular.missing_value_ratio(df), tabular.row_sparsity(df), tabular.outlier_zscore(df), tabular.numerical_range_score(df), tabular.row_distance_to_mean(df), tabular.multi_column_sort(df, ["_m", "a.b"])):
        assert found.count() == 4
    assert ranking.cut_groups(df.withColumn("n", df.id % 2), "n", 0.5).columns == [*df.columns, "n", "split"]


def test_tables_without_numbers(spark):
    df = spark.createDataFrame([("x", "b"), ("y", "a")], "id string, name string")
    for found in (tabular.numerical_range_score(df), tabular.row_distance_to_mean(df), tabular.row_sparsity(df), tabular.outlier_zscore(df), tabular.outlier_score(df, "lof")):
        assert scores(found) == {"x": 0.0, "y": 0.0}
    ranks = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "id int, name string")
    assert scores(tabular.column_rank(ranks, "name")) == {0: 62.5, 1: 25.0, 2: 100.0, 3: 62.5}


def test_outlier_score_methods(spark):
    rows = [(0, 48.0, 49, "a"), (1, 52.0, 51, "b"), (2, None, 50, None), (3, 51.0, 52, "c"), (4, 1000.0, 1000, "d")]
    df = spark.createDataFrame(rows, "id int, a double, b int, c string")
    for method, options in (("isolation_forest", {}), ("lof", {"k": 2}), ("zscore", {})):
        found = tabular.outlier_score(df, method, **options)
        assert order(found)[-1] == 4 and order(tabular.outlier_score(df, method, low_first=False, **options))[0] == 4, method
    with pytest.raises(ValueError):
        tabular.outlier_score(df, "unknown")
    a = [48, 52, 51.5, 51, 1000]
    mean, sd = sum(a) / 5, (sum((x - sum(a) / 5) ** 2 for x in a) / 5) ** 0.5
    b = [49, 51, 50, 52, 1000]
    mb, sb = sum(b) / 5, (sum((x - sum(b) / 5) ** 2 for x in b) / 5) ** 0.5
    assert scores(tabular.outlier_score(df, "zscore")) == pytest.approx({i: (abs(a[i] - mean) / sd + abs(b[i] - mb) / sb) / 2 for i in range(5)}, abs=2e-6)
    assert tabular.outlier_score(df.where("id < 0"), "lof").collect() == [] and tabular.outlier_score(df.where("id < 0")).collect() == []
