"""Registry of the engine's queries and, where SQL can express them, their oracle SQL (DuckDB dialect).

Every query runs over its whole tables. Scores are rounded before they are ranked, on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.functions.numbers import rounded
from cleaveset.functions.vectors import METRICS
from cleaveset.operators import audio, cluster, embedding, graph, image, metrics, pairwise, splits, tabular, text
from cleaveset.operators.ranking import cut_by_ratio, rank_by, train_size
from cleaveset.sources import generators
from cleaveset.store import Store
from cleaveset.streaming import scorers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"), "label")


def _on(table: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(_vectors(spark, sf_dir) if table == "embeddings" else _table(spark, sf_dir, table))


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# SQL parts --------------------------------------------------------------------------------------------------------
V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
MEAN = "SELECT {by}list(x ORDER BY pos) AS c FROM (SELECT {by}pos, avg(x) AS x FROM (SELECT {by}unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY ALL) {group}"
C = f"c AS ({MEAN.format(by='', group='')})"
CL = f"cl AS ({MEAN.format(by='label, ', group='GROUP BY label')})"


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


PAIRS = f"p AS (SELECT a.id, b.id AS other, {l2('a.e', 'b.e')} AS d FROM v a JOIN v b ON a.id <> b.id)"
DIST = f"s AS (SELECT id, round({l2('e', 'c')}, 6) AS score FROM v, c)"


def ranked(source: str, low_first: bool = True, tail: str = "") -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score {'ASC' if low_first else 'DESC'} NULLS LAST, id) AS pos{tail} FROM {source}"


def cut(source: str, low_first: bool = True) -> str:
    return f"SELECT *, CASE WHEN pos <= floor((SELECT count(*) FROM s) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ({ranked(source, low_first)})"


def with_scores(sql: str, low_first: bool = True) -> str:
    return f"WITH s AS ({sql}) {ranked('s', low_first)}"


def knn(k: int) -> str:
    return f"n AS (SELECT * FROM (SELECT id, other, round(d, 9) AS d, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS r FROM p) WHERE r <= {k})"


def grouped(inner: str, group: str, least: int = 0) -> str:
    return f"""SELECT {inner}, CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY md5(id::VARCHAR || ':42'), id)
    <= greatest({least}, floor(count(*) OVER (PARTITION BY {group}) * 0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS split"""


def binned() -> str:
    edges = ", ".join(f"round(quantile_cont(score, {i / 10!r}), 6)" for i in range(1, 10))
    return f"q AS (SELECT [{edges}] AS edges FROM s), b AS (SELECT id, len(list_filter(edges, lambda x: x <= score))::INT AS bin FROM s, q)"


# Embeddings -------------------------------------------------------------------------------------------------------
add("emb_centroid", _on("embeddings", metrics.compute_centroid), f"WITH {V}, {C} SELECT (generate_subscripts(c, 1) - 1)::INT AS pos, round(unnest(c), 9) AS value FROM c")
add("emb_mean_dist", _on("embeddings", metrics.mean_dist), f"WITH {V}, {C} SELECT round(avg({l2('e', 'c')}), 6) AS mean_dist FROM v, c")
add("emb_distance_to_mean", _on("embeddings", embedding.distance_to_mean), f"WITH {V}, {C}, {DIST} {ranked('s')}")
add("emb_nearest_neighbor", _on("embeddings", embedding.distance_to_nearest_neighbor), f"WITH {V}, {PAIRS}, s AS (SELECT id, min(round(d, 6)) AS score FROM p GROUP BY id) {ranked('s')}")
DENSITY = f"WITH {V}, {PAIRS}, r AS (SELECT {{}} AS r FROM p), s AS (SELECT id, count(*) FILTER (round(d, 6) <= r) AS score FROM p, r GROUP BY id) {ranked('s')}"
add("emb_local_density", _on("embeddings", embedding.local_density), DENSITY.format("round(quantile_cont(d, 0.5), 6)"))
add("emb_local_density_radius", _on("embeddings", lambda v: embedding.local_density(v, 1.3)), DENSITY.format("max(1.3::DOUBLE)"))
LOF = f"""WITH {V}, {PAIRS}, {knn(20)}, k AS (SELECT id, max(d) AS kd FROM n GROUP BY id),
l AS (SELECT n.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.id = n.other GROUP BY n.id),
s AS (SELECT n.id, round(avg(o.lrd) / min(l.lrd), 6) AS score FROM n JOIN l o ON o.id = n.other JOIN l ON l.id = n.id GROUP BY n.id) {ranked('s')}"""
add("emb_lof", _on("embeddings", lambda v: embedding.outlier_score(v, "lof")), LOF)
add("emb_isolation_forest", _on("embeddings", embedding.outlier_score))
add("emb_pairwise_cosine", _on("embeddings", lambda v: pairwise.nearest(v, k=3, metric="cosine", digits=6).select("id", "other", F.col("d").alias("distance"), F.col("place").cast("long").alias("place"))),
    f"WITH {V}, p AS (SELECT a.id, b.id AS other, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.id <> b.id) SELECT id, other, distance, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS place FROM p QUALIFY place <= 3")

# Splits with oracles ----------------------------------------------------------------------------------------------
add("split_random", _on("embeddings", splits.random_split), f"WITH {V} SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM v")
add("split_distance_adversarial", _on("embeddings", splits.distance_adversarial_split), f"WITH {V}, {C}, {DIST} {cut('s')}")
KNN_DENSITY = f"{PAIRS}, {knn(10)}, s AS (SELECT id, round(1 / (avg(d) + 1e-10), 6) AS score FROM n GROUP BY id)"
add("split_density_adversarial", _on("embeddings", splits.density_adversarial_split), f"WITH {V}, {KNN_DENSITY} {cut('s', False)}")
add("split_density_balanced", _on("embeddings", splits.density_balanced_split), f"WITH {V}, {KNN_DENSITY}, {binned()} {grouped('id, bin', 'bin', 1)} FROM b")
add("split_stratified_similarity", _on("embeddings", splits.stratified_similarity_split), f"WITH {V}, {C}, {DIST}, {binned()} {grouped('id, bin', 'bin', 1)} FROM b")
add("split_stratified_random", _on("embeddings", lambda v: splits.stratified_random_split(v, "label")), f"""
WITH {V}, q AS (SELECT label, count(*) AS n, floor(count(*) * 0.7::DOUBLE) AS base, round(count(*) * 0.7::DOUBLE - floor(count(*) * 0.7::DOUBLE), 9) AS rest FROM v GROUP BY label),
k AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= floor(sum(n) OVER ()::DOUBLE * 0.7::DOUBLE) - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM q)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY v.label ORDER BY md5(id::VARCHAR || ':42'), id) <= k THEN 'train' ELSE 'test' END AS split FROM v JOIN k ON k.label = v.label""")
add("split_cluster_leak", _on("embeddings", lambda v: splits.cluster_leak_split(v, cluster="label")), f"WITH {V} {grouped('id', 'label')} FROM v")


def _per_label(v: DataFrame) -> DataFrame:
    order = embedding.per_label_order(v, "label")
    return order.select("id", "label", "score", "pos", F.when(F.col("pos") <= train_size(F.col("n"), 0.7), "train").otherwise("test").alias("split"))


add("demo_per_label_split", _on("embeddings", _per_label), f"""
WITH {V}, {CL}, s AS (SELECT id, v.label, round({l2('e', 'c')}, 6) AS score FROM v JOIN cl ON cl.label = v.label)
SELECT id, label, score, row_number() OVER (PARTITION BY label ORDER BY score, id) AS pos,
       CASE WHEN pos <= floor(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM s""")

FOLD = """, f AS (
  SELECT k, cluster, n, n <= t AS fits, CASE WHEN n <= t THEN n ELSE 0 END AS total, t FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.cluster, o.n, f.total + o.n <= o.t, f.total + CASE WHEN f.total + o.n <= o.t THEN o.n ELSE 0 END, o.t FROM f JOIN o ON o.k = f.k + 1)
SELECT id, CASE WHEN fits THEN 'train' ELSE 'test' END AS split FROM v JOIN f ON f.cluster = v.label"""
TARGET = "(SELECT floor(count(*) * 0.7::DOUBLE) FROM v)"
add("split_cluster_fit_or_skip", _on("embeddings", lambda v: splits.cluster_split(v, cluster="label")),
    f"WITH RECURSIVE {V}, o AS (SELECT label AS cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS k, {TARGET} AS t FROM v GROUP BY label){FOLD}")
add("split_centroid_fit_or_skip", _on("embeddings", lambda v: splits.centroid_adversarial_split(v, cluster="label")),
    f"WITH RECURSIVE {V}, {C}, {CL}, g AS (SELECT label, count(*) AS n FROM v GROUP BY label), o AS (SELECT g.label AS cluster, n, row_number() OVER (ORDER BY round({l2('cl.c', 'c.c')}, 6), g.label) AS k, {TARGET} AS t FROM g JOIN cl ON cl.label = g.label, c){FOLD}")


def _with_split(v: DataFrame) -> DataFrame:
    return v.join(splits.random_split(v), "id")


RANDOM = "r AS (SELECT id, e, label, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM v)"
add("cluster_leakage", _on("embeddings", lambda v: cluster.cluster_info(_with_split(v), "label")), f"""
WITH {V}, {RANDOM}, g AS (SELECT label, count(*) AS total, count(*) FILTER (split = 'train') AS in_train, count(*) FILTER (split = 'test') AS in_test FROM r GROUP BY label)
SELECT label, total, in_train, in_test, least(in_train, in_test) AS leakage, round(count(*) FILTER (least(in_train, in_test) > 0) OVER () / count(*) OVER (), 6) AS leak_ratio FROM g""")
add("split_similarity_report", _on("embeddings", lambda v: metrics.split_similarity(_with_split(v).select("id", "e", "split"))), f"""
WITH {V}, {RANDOM}, {PAIRS}, m AS (SELECT round(quantile_cont(d, 0.5), 6) AS m FROM p),
cs AS (SELECT split, list(x ORDER BY pos) AS c FROM (SELECT split, pos, avg(x) AS x FROM (SELECT split, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM r) GROUP BY ALL) GROUP BY split),
n AS (SELECT p.id, min(round(d, 6)) AS d FROM p JOIN r a ON a.id = p.id AND a.split = 'test' JOIN r b ON b.id = p.other AND b.split = 'train' GROUP BY p.id)
SELECT (SELECT round({l2('a.c', 'b.c')}, 6) FROM cs a, cs b WHERE a.split = 'train' AND b.split = 'test') AS centroid_distance, round(avg(d), 6) AS mean_nearest, round(avg((d <= m)::INT::DOUBLE), 6) AS coverage FROM n, m""")
add("split_ks_report", _on("embeddings", lambda v: metrics.kolmogorov_smirnov(_with_split(v))), f"""
WITH {V}, {RANDOM}, u AS (SELECT split, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM r),
g AS (SELECT pos, x, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM u GROUP BY pos, x),
k AS (SELECT pos, abs(sum(a) OVER (PARTITION BY pos ORDER BY x)::DOUBLE / sum(a) OVER (PARTITION BY pos) - sum(b) OVER (PARTITION BY pos ORDER BY x)::DOUBLE / sum(b) OVER (PARTITION BY pos)) AS gap FROM g)
SELECT pos::INT AS pos, round(max(gap), 6) AS ks FROM k GROUP BY pos""")
add("split_duplicate_spread", _on("embeddings", lambda v: splits.duplicate_spread_split(v, similarity_threshold=1.05)), f"""
WITH RECURSIVE {V}, {PAIRS}, k AS (SELECT id AS a, other AS b FROM p WHERE d <= 1.05), w(a, b) AS (SELECT a, b FROM k UNION SELECT w.a, k.b FROM w JOIN k ON k.a = w.b),
g AS (SELECT v.id, least(v.id, coalesce(min(w.b), v.id)) AS component FROM v LEFT JOIN w ON w.a = v.id GROUP BY v.id),
z AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY md5(id::VARCHAR || ':42'), id) AS r FROM g)
SELECT id, component, CASE WHEN r <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * 0.7::DOUBLE), 1), n - 1) END THEN 'train' ELSE 'test' END AS split FROM z""")

add("split_duplicate_spread_default", _on("embeddings", splits.duplicate_spread_split), f"""
WITH RECURSIVE {V}, {PAIRS}, t AS (SELECT quantile_cont(d, 0.1) AS t FROM p), k AS (SELECT id AS a, other AS b FROM p, t WHERE d <= t),
w(a, b) AS (SELECT a, b FROM k UNION SELECT w.a, k.b FROM w JOIN k ON k.a = w.b),
g AS (SELECT v.id, least(v.id, coalesce(min(w.b), v.id)) AS component FROM v LEFT JOIN w ON w.a = v.id GROUP BY v.id),
z AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY md5(id::VARCHAR || ':42'), id) AS r FROM g)
SELECT id, component, CASE WHEN r <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * 0.7::DOUBLE), 1), n - 1) END THEN 'train' ELSE 'test' END AS split FROM z""")
DBSCAN = f"""WITH RECURSIVE {V}, {PAIRS}, nb AS (SELECT id AS a, other AS b FROM p WHERE d <= 1.15),
core AS (SELECT v.id FROM v LEFT JOIN nb ON nb.a = v.id GROUP BY v.id HAVING count(nb.b) + 1 >= 4),
li AS (SELECT a, b FROM nb JOIN core x ON x.id = a JOIN core y ON y.id = b),
w(a, b) AS (SELECT a, b FROM li UNION SELECT w.a, li.b FROM w JOIN li ON li.a = w.b),
co AS (SELECT core.id, least(core.id, coalesce(min(w.b), core.id)) AS root FROM core LEFT JOIN w ON w.a = core.id GROUP BY core.id),
nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM co)),
na AS (SELECT id, cluster FROM co JOIN nu ON nu.root = co.root),
bo AS (SELECT nb.b AS id, min(cluster) AS border FROM nb JOIN na ON na.id = nb.a GROUP BY nb.b),
c AS (SELECT v.id, coalesce(na.cluster, bo.border, -1)::INT AS cluster FROM v LEFT JOIN na ON na.id = v.id LEFT JOIN bo ON bo.id = v.id)"""
add("emb_dbscan", _on("embeddings", lambda v: cluster.dbscan(v.select("id", "e"), 1.15, 4).select("id", "cluster")), f"{DBSCAN} SELECT id, cluster FROM c")
add("split_dbscan", _on("embeddings", lambda v: splits.cluster_split(v.select("id", "e"), method="dbscan", eps=1.15, min_samples=4)), f"""{DBSCAN},
o AS (SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS k, {TARGET} AS t FROM c WHERE cluster >= 0 GROUP BY cluster),
f AS (
  SELECT k, cluster, n, n <= t AS fits, CASE WHEN n <= t THEN n ELSE 0 END AS total, t FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.cluster, o.n, f.total + o.n <= o.t, f.total + CASE WHEN f.total + o.n <= o.t THEN o.n ELSE 0 END, o.t FROM f JOIN o ON o.k = f.k + 1)
SELECT c.id, CASE WHEN fits THEN 'train' ELSE 'test' END AS split FROM c LEFT JOIN f ON f.cluster = c.cluster""")


def _label_distances(v: DataFrame) -> DataFrame:
    """Distances of all pairs of label centroids, by each metric."""
    own = Store(v.sparkSession).keep(embedding.centroid(v, ("label",)).select(F.col("label").alias("id"), F.col("c").alias("e")), "centroids")
    out = None
    for metric in METRICS:
        one = pairwise.pairwise_distances(own, metric).select(F.lit(metric).alias("metric"), "a", "b", rounded("d", 6).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


METRIC_SQL = {
    "euclidean": "sqrt(list_sum(list_transform(g, lambda x: x * x)))",
    "sqeuclidean": "list_sum(list_transform(g, lambda x: x * x))",
    "cityblock": "list_sum(list_transform(g, lambda x: abs(x)))",
    "chebyshev": "list_max(list_transform(g, lambda x: abs(x)))",
    "cosine": "1 - list_cosine_similarity(x, y)",
}
add("emb_label_distances", _on("embeddings", _label_distances), f"""
WITH {V}, {CL}, p AS (SELECT a.label AS a, b.label AS b, a.c AS x, b.c AS y, list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] - b.c[i]) AS g FROM cl a, cl b)
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, a, b, abs(round({f}, 6)) AS distance FROM p" for m, f in METRIC_SQL.items()))

# Splits held by invariants in the tests ----------------------------------------------------------------------------
for _name, _split in {
    "split_kmeans": splits.cluster_split,
    "split_centroid_kmeans": splits.centroid_adversarial_split,
    "split_kmeans_leak": splits.cluster_leak_split,
    "split_outlier_forest": splits.outlier_adversarial_split,
    "split_min_cut": splits.min_cut_split,
    "split_stoer_wagner": lambda v: splits.min_cut_split(v, method="stoer_wagner"),
    "split_normalized_cut": splits.normalized_cut_split,
    "split_centroid_matched": splits.centroid_matched_split,
    "split_distribution_matched": splits.distribution_matched_split,
    "split_moment_matched": splits.moment_matched_split,
    "split_histogram_matched": splits.histogram_matched_split,
    "split_mmd_minimized": splits.mmd_minimized_split,
    "split_neighbor_coverage": splits.neighbor_coverage_split,
    "split_nearest_neighbor": splits.nearest_neighbor_split,
    "split_max_coverage": splits.max_coverage_split,
}.items():
    add(_name, _on("embeddings", lambda v, split=_split: split(v.select("id", "e"))))

# Tables -----------------------------------------------------------------------------------------------------------
CUSTOMER = "SELECT c_custkey AS id, {} AS score FROM customer"
add("tab_column_value", _on("customer", lambda t: tabular.column_value(t, "c_acctbal", "c_custkey", False)), with_scores(CUSTOMER.format("c_acctbal"), False))
add("tab_column_value_text", _on("part", lambda t: tabular.column_value(t, "p_name", "p_partkey")), with_scores("SELECT p_partkey AS id, p_name AS score FROM part"))
TEXT_RANK = "SELECT p_partkey AS id, round((rank() OVER (ORDER BY p_brand NULLS LAST) + (count(*) OVER (PARTITION BY p_brand) - 1) / 2) / count(*) OVER () * 100, 6) AS score FROM part"
add("tab_column_rank_text", _on("part", lambda t: tabular.column_rank(t, "p_brand", "p_partkey")), with_scores(TEXT_RANK))
RANK = "SELECT {id} AS id, round((rank() OVER (ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {v}) - 1) / 2) / count(*) OVER () * 100, 6) AS score FROM {t}"
add("tab_column_rank", _on("part", lambda t: tabular.column_rank(t, "p_size", "p_partkey")), with_scores(RANK.format(id="p_partkey", v="p_size", t="part")))
Z = "(c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()"
add("tab_column_zscore", _on("customer", lambda t: tabular.column_zscore(t, "c_acctbal", "c_custkey")), with_scores(CUSTOMER.format(f"round({Z}, 6)")))
add("tab_absolute_zscore", _on("customer", lambda t: tabular.column_zscore(t, "c_acctbal", "c_custkey", False, True)), with_scores(CUSTOMER.format(f"round(abs({Z}), 6)"), False))
add("tab_missing_ratio", lambda s, d: tabular.missing_value_ratio(_table(s, d, "documents").join(_table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic"), "doc_id", False),
    with_scores("SELECT doc_id AS id, round(((lang IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT)::DOUBLE / 3, 6) AS score FROM documents LEFT JOIN labels USING (doc_id)", False))
add("tab_row_sparsity", _on("lineitem", lambda t: tabular.row_sparsity(t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax"))),
    with_scores("SELECT l_orderkey * 10 + l_linenumber AS id, round(((abs(l_quantity) < 1e-10)::INT + (abs(l_discount) < 1e-10)::INT + (abs(l_tax) < 1e-10)::INT)::DOUBLE / 3, 6) AS score FROM lineitem"))
add("tab_outlier_zscore", _on("part", lambda t: tabular.outlier_zscore(t.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", False)),
    with_scores("SELECT p_partkey AS id, round((abs(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () + abs(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()) / 2, 6) AS score FROM part", False))
RANGE = " + ".join(f"abs((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER () * 100 - 50)" for c in ("p_size", "p_retailprice"))
add("tab_numerical_range", _on("part", lambda t: tabular.numerical_range_score(t.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")), with_scores(f"SELECT p_partkey AS id, round(({RANGE}) / 2, 6) AS score FROM part"))
add("tab_categorical_rarity", _on("customer", lambda t: tabular.categorical_rarity(t, "c_mktsegment", "c_custkey")), with_scores(CUSTOMER.format("round(count(*) OVER (PARTITION BY c_mktsegment) / count(c_mktsegment) OVER (), 6)"), False))
ENTROPY = " + ".join(f"-ln(count(*) OVER (PARTITION BY {c}) / count(*) OVER () + 1e-10)" for c in ("p_brand", "p_type"))
add("tab_feature_entropy", _on("part", lambda t: tabular.feature_entropy(t.select("p_partkey", "p_brand", "p_type"), "p_partkey", False)), with_scores(f"SELECT p_partkey AS id, round({ENTROPY}, 6) AS score FROM part", False))
MD = " + ".join(f"pow({c} - avg({c}) OVER (), 2)" for c in ("p_size", "p_retailprice"))
add("tab_distance_to_mean", _on("part", lambda t: tabular.row_distance_to_mean(t.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")), with_scores(f"SELECT p_partkey AS id, round(sqrt({MD}), 6) AS score FROM part"))
SCALED = "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
add("tab_multi_column", _on("part", lambda t: tabular.multi_column_sort(t, ["p_size", "p_retailprice"], [2.0, -1.0], "p_partkey")),
    with_scores(f"SELECT p_partkey AS id, round(2.0::DOUBLE * ({SCALED.format(c='p_size')}) - ({SCALED.format(c='p_retailprice')}), 6) AS score FROM part"))
_PART = lambda t: t.select("p_partkey", "p_size", "p_retailprice")
add("tab_isolation_forest", _on("part", lambda t: tabular.outlier_score(_PART(t), "isolation_forest", "p_partkey")))
add("tab_outlier_lof", _on("part", lambda t: tabular.outlier_score(_PART(t), "lof", "p_partkey")), LOF.replace(V, "v AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS e FROM part)"))


def _cut_table(t: DataFrame) -> DataFrame:
    return cut_by_ratio(rank_by(t.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))).select("id", "score", "pos", "split")


add("tab_rank_and_cut", _on("orders", _cut_table), f"WITH s AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders) {cut('s')}")

# Texts ------------------------------------------------------------------------------------------------------------
TOKENS = r"regexp_extract_all(text, '[^\s]+')"
DOC = "SELECT doc_id AS id, {} AS score FROM documents"
add("txt_char_length", _on("documents", lambda t: text.character_length(t, id_col="doc_id")), with_scores(DOC.format("length(text)::INT")))
add("txt_token_length", _on("documents", lambda t: text.tokens_length(t, id_col="doc_id", short_first=False)), with_scores(DOC.format(f"len({TOKENS})::INT"), False))
add("txt_lexical_diversity", _on("documents", lambda t: text.lexical_diversity(t, id_col="doc_id")), with_scores(DOC.format(f"round(CASE WHEN len({TOKENS}) > 0 THEN len(list_distinct({TOKENS})) / len({TOKENS}) ELSE 0.0 END, 6)")))
add("txt_sentence_count", _on("documents", lambda t: text.sentence_count(t, id_col="doc_id")))
add("txt_vocabulary_rarity", _on("documents", lambda t: text.vocabulary_rarity(t, text.corpus_frequencies(t), id_col="doc_id")), rf"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[^\s]+')) AS w FROM documents), f AS (SELECT w, count(*) / sum(count(*)) OVER () AS f FROM t GROUP BY w),
s AS (SELECT d.doc_id AS id, round(coalesce(m, 0.0), 6) AS score FROM documents d LEFT JOIN (SELECT id, sum(1 - f) / count(*) AS m FROM t JOIN f USING (w) GROUP BY id) x ON x.id = d.doc_id) {ranked('s')}""")
#: Familiar words of the Dale-Chall grade: a short list, as the grade's own isn't at hand.
EASY = "a about after all also an and any are as at be been before but by can could day did do down each even find first for from get give go good great had has have he her here him his how if in into is it its just know like little long look made make many may me more most much must my new no not now of off old on one only or other our out over own people said same see she should so some such take than that the their them then there these they thing this time to two under up us use very was water way we well went were what when where which who will with work would year you your".split()
COUNTS = r"""WITH a AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS ws, greatest(1, len(regexp_extract_all(text, '[.!?]+')))::DOUBLE AS s, len(regexp_extract_all(lower(text), '[a-z]'))::DOUBLE AS l FROM documents),
b AS (SELECT id, s, l, len(ws)::DOUBLE AS w, ws, list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^l]e$') THEN 1 ELSE 0 END)) AS ys FROM a),
c AS (SELECT id, s, l, w, ws, coalesce(list_sum(ys), 0)::DOUBLE AS y, len(list_filter(ys, lambda x: x >= 3))::DOUBLE AS h FROM b),
s AS (SELECT id, CASE WHEN w >= 100 THEN round({}, 6) ELSE 'inf'::DOUBLE END AS score FROM c) """
DIFFICULT = f"len(list_filter(ws, lambda x: NOT list_contains([{', '.join(repr(x) for x in EASY)}], x))) / w * 100"
for _name, _formula in {
    "flesch_kincaid": "0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE",
    "flesch": "206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / w)",
    "gunning_fog": "0.4::DOUBLE * (w / s + 100 * (h / w))",
    "coleman_liau": "0.0588::DOUBLE * (100 * l / w) - 0.296::DOUBLE * (100 * s / w) - 15.8::DOUBLE",
    "ari": "4.71::DOUBLE * (l / w) + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE",
    "linsear_write": "CASE WHEN (w - h + 3 * h) / s > 20 THEN (w - h + 3 * h) / s / 2 ELSE ((w - h + 3 * h) / s - 2) / 2 END",
    "smog": "CASE WHEN s >= 30 THEN 1.043::DOUBLE * sqrt(30 * (h / s)) + 3.1291::DOUBLE ELSE 'inf'::DOUBLE END",
    "dale_chall": f"0.1579::DOUBLE * ({DIFFICULT}) + 0.0496::DOUBLE * (w / s) + CASE WHEN {DIFFICULT} > 5 THEN 3.6365::DOUBLE ELSE 0 END",
}.items():
    add(f"txt_readability_{_name}", _on("documents", lambda t, m=_name: text.readability_score(t, m, id_col="doc_id", easy_words=EASY)), COUNTS.format(_formula) + ranked("s"))
add("txt_bigram_perplexity", _on("conversations", lambda t: text.bigram_perplexity(t.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")))), rf"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[^\s]+') AS t FROM conversations), u AS (SELECT * FROM t WHERE len(t) >= 2),
p AS (SELECT id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p FROM u), b AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT a, sum(n) AS na FROM b GROUP BY a),
z AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM u)),
s AS (SELECT t.id, round(coalesce(exp(m), 'inf'::DOUBLE), 6) AS score FROM t LEFT JOIN (SELECT p.id, -sum(ln((n + 1)::DOUBLE / (na + v)::DOUBLE)) / count(*) AS m FROM p JOIN b ON b.a = p.p.a AND b.b = p.p.b JOIN o ON o.a = p.p.a, z GROUP BY p.id) x ON x.id = t.id) {ranked('s')}""")


def _neighbours(t: DataFrame) -> DataFrame:
    """Each benchmark item beside the next one in the order of ids; the last is beside none."""
    order = rank_by(t.select("item_id", "text", F.col("item_id").alias("score")), "score", "item_id").select("item_id", "text", "pos")
    after = order.select((F.col("pos") - 1).alias("pos"), F.col("text").alias("y"))
    return order.join(after, "pos").select(F.col("item_id").alias("id"), F.col("text").alias("x"), "y")


GRAMS = "list_transform(range(1, greatest(len({x}) - {k}, 0) + 1), lambda i: array_to_string({x}[i:i + {k}], chr(31)))"
SIMILARITY = " + ".join(f"coalesce(len(list_intersect({GRAMS.format(x='x', k=k)}, {GRAMS.format(x='y', k=k)})) / nullif(len(list_distinct({GRAMS.format(x='x', k=k)} || {GRAMS.format(x='y', k=k)})), 0), 0)" for k in range(3))
add("txt_ngram_jaccard", _on("benchmark", lambda t: _neighbours(t).select("id", rounded(fn.ngram_jaccard_similarity(F.col("x"), F.col("y")), 6).alias("similarity"), rounded(fn.ngram_jaccard_distance(F.col("x"), F.col("y")), 6).alias("distance"))), rf"""
WITH t AS (SELECT item_id AS id, {TOKENS} AS t FROM benchmark), p AS (SELECT id, t AS x, lead(t) OVER (ORDER BY id) AS y FROM t QUALIFY y IS NOT NULL), s AS (SELECT id, ({SIMILARITY}) / 3 AS s FROM p)
SELECT id, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM s""")
add("txt_diversity", _on("benchmark", lambda t: text.diversity_text(t, id_col="item_id")), rf"""
WITH t AS (SELECT {TOKENS} AS t FROM benchmark), p AS (SELECT a.t AS x, b.t AS y FROM t a, t b) SELECT round(avg(1 - ({SIMILARITY}) / 3), 6) AS diversity FROM p""")
add("txt_difflib", _on("benchmark", lambda t: _neighbours(t).select("id", fn.difflib_character_similarity("x", "y").alias("characters"), fn.difflib_token_similarity(F.col("x"), F.col("y")).alias("tokens"))))

# Signals: the values of a user's events in time order ---------------------------------------------------------------
_samples = lambda t: t.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("t"), (F.col("value") - 50).alias("y"))
SIGNAL = "y AS (SELECT user_id AS id, ts, event_id, value - 50 AS y FROM events), s AS (SELECT id, round({}, 6) AS score FROM y GROUP BY id) "
for _name, _score, _sql in (
    ("mean_amplitude", audio.mean_amplitude, "avg(abs(y))"),
    ("rms_energy", audio.rms_energy, "sqrt(avg(y * y))"),
    ("dynamic_range", audio.dynamic_range, "max(abs(y)) - min(abs(y))"),
    ("peak_to_average", audio.peak_to_average_ratio, "coalesce(max(abs(y)) / nullif(avg(abs(y)), 0.0), 0.0)"),
):
    add(f"sig_{_name}", _on("events", lambda t, f=_score: f(_samples(t))), "WITH " + SIGNAL.format(_sql) + ranked("s"))
add("sig_zero_crossings", _on("events", lambda t: audio.zero_crossings(_samples(t))),
    f"WITH y AS (SELECT user_id AS id, CASE WHEN (value - 50 < 0) <> lag(value - 50 < 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS x FROM events), s AS (SELECT id, round(sum(x) / count(*), 6) AS score FROM y GROUP BY id) {ranked('s')}")
SOUND = """i AS (SELECT i AS id, t.k AS k, 0.5::DOUBLE * sin(2 * pi() * 200 * (i + 1) * k / 22050) + 0.1::DOUBLE * i * (((k * k * 7919 + (i + 1) * k * 104729) % 1000) / 1000 - 0.5::DOUBLE) AS y FROM range(4) r(i), range(2048) t(k)),
w AS (SELECT id, f.f AS f, k - (f.f * 512 - 1024) AS n, y * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (k - (f.f * 512 - 1024)) / 2048)) AS y FROM i, range(5) f(f) WHERE k - (f.f * 512 - 1024) BETWEEN 0 AND 2047),
m AS (SELECT id, f, b.b AS b, sqrt(pow(sum(y * cos(2 * pi() * ((b.b * n) % 2048) / 2048)), 2) + pow(sum(y * sin(2 * pi() * ((b.b * n) % 2048) / 2048)), 2)) AS m, b.b * 22050::DOUBLE / 2048 AS h FROM w, range(1025) b(b) GROUP BY id, f, b.b),
c AS (SELECT id, f, sum(h * m) / sum(m) AS c FROM m GROUP BY id, f)"""
SPECTRA = {
    "spectral_centroid": "s AS (SELECT id, round(avg(c), 6) AS score FROM c GROUP BY id)",
    "spectral_bandwidth": "u AS (SELECT m.id, m.f, sqrt(sum(m * (h - c) * (h - c)) / sum(m)) AS v FROM m JOIN c ON c.id = m.id AND c.f = m.f GROUP BY m.id, m.f), s AS (SELECT id, round(avg(v), 6) AS score FROM u GROUP BY id)",
    "spectral_rolloff": "q AS (SELECT id, f, h, sum(m) OVER (PARTITION BY id, f ORDER BY b) AS t, sum(m) OVER (PARTITION BY id, f) AS a FROM m), u AS (SELECT id, f, min(h) FILTER (t >= 0.85::DOUBLE * a) AS v FROM q GROUP BY id, f), s AS (SELECT id, round(avg(v), 6) AS score FROM u GROUP BY id)",
    "spectral_flatness": "u AS (SELECT id, f, exp(avg(ln(greatest(m * m, 1e-10::DOUBLE)))) / avg(greatest(m * m, 1e-10::DOUBLE)) AS v FROM m GROUP BY id, f), s AS (SELECT id, round(avg(v), 6) AS score FROM u GROUP BY id)",
    "zero_crossing_rate": "e AS (SELECT i.id, f.f AS f, n.n AS n, i.y < 0 AS z FROM range(5) f(f), range(2048) n(n) JOIN i ON i.k = least(greatest(f.f * 512 - 1024 + n.n, 0), 2047)), u AS (SELECT id, f, n, z <> lag(z) OVER (PARTITION BY id, f ORDER BY n) AS x FROM e), s AS (SELECT id, round(sum(x::INT) / (5.0::DOUBLE * 2047), 6) AS score FROM u GROUP BY id)",
}
for _name in audio.SPECTRAL:
    add(f"aud_{_name}", lambda spark, d, n=_name: audio.spectral(generators.sound_table(spark), n))
for _name, _sql in SPECTRA.items():
    add(f"aud_formula_{_name}", lambda spark, d, n=_name: audio.spectral(generators.formula_sounds(spark), n), f"WITH {SOUND}, {_sql} {ranked('s')}")

# Images: pixels by formula, and the named fixtures ------------------------------------------------------------------
PIXELS = "x AS (SELECT r.i // 2500 AS id, r.i % 50 AS x, r.i // 50 % 50 AS y FROM range(50000) r(i)), p AS (SELECT id, (x * 5 + id * 7) % 256 AS r, (y * 5 + id * id) % 256 AS g, (x * y + id) % 256 AS b FROM x)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spark.range(50000).select(F.floor(F.col("id") / 2500).alias("id"), (F.col("id") % 50).alias("x"), (F.floor(F.col("id") / 50) % 50).alias("y"))
    return at.select("id", ((F.col("x") * 5 + F.col("id") * 7) % 256).alias("r"), ((F.col("y") * 5 + F.col("id") * F.col("id")) % 256).alias("g"), ((F.col("x") * F.col("y") + F.col("id")) % 256).alias("b"))


GRAY = "floor((r * 299 + g * 587 + b * 114) / 1000)"
for _name, _score, _sql in (
    ("brightness", image.mean_brightness, f"avg({GRAY})"),
    ("contrast", image.contrast, f"stddev_pop({GRAY})"),
    ("color_variance", image.color_variance, "avg((pow(r - (r + g + b) / 3, 2) + pow(g - (r + g + b) / 3, 2) + pow(b - (r + g + b) / 3, 2)) / 3)"),
):
    add(f"img_{_name}", lambda spark, d, f=_score: f(_pixels(spark, d)), f"WITH {PIXELS}, s AS (SELECT id, round({_sql}, 6) AS score FROM p GROUP BY id) {ranked('s')}")
for _name, _score in (("frequency", image.frequency_content), ("dominant_color", image.dominant_color), ("zlib_ratio", image.zlib_ratio)):
    add(f"img_{_name}", lambda spark, d, f=_score: f(generators.image_table(spark)))

FREQUENCY = f"""WITH {PIXELS}, g AS (SELECT p.id, p.px, p.py, {GRAY.format()} AS g FROM (SELECT id, x AS px, y AS py, (x * 5 + id * 7) % 256 AS r, (y * 5 + id * id) % 256 AS g, (x * y + id) % 256 AS b FROM x) p),
a AS (SELECT id, py, u.u AS u, sum(g * cos(2 * pi() * ((u.u * px) % 50) / 50)) AS re, -sum(g * sin(2 * pi() * ((u.u * px) % 50) / 50)) AS im FROM g, range(50) u(u) GROUP BY id, py, u.u),
f AS (SELECT id, u, v.v AS v, sum(re * cos(2 * pi() * ((v.v * py) % 50) / 50) + im * sin(2 * pi() * ((v.v * py) % 50) / 50)) AS re, sum(im * cos(2 * pi() * ((v.v * py) % 50) / 50) - re * sin(2 * pi() * ((v.v * py) % 50) / 50)) AS im FROM a, range(50) v(v) GROUP BY id, u, v.v),
h AS (SELECT id, sqrt(re * re + im * im) AS m, sqrt(pow((u + 25) % 50 - 25, 2) + pow((v + 25) % 50 - 25, 2)) AS d FROM f),
s AS (SELECT id, round(sum(m) FILTER (d > 6) / sum(m), 6) AS score FROM h GROUP BY id) {ranked('s')}"""
add("img_formula_frequency", lambda spark, d: image.frequency_content(generators.formula_images(spark)), FREQUENCY)

# Generated points ------------------------------------------------------------------------------------------------------
def _uniform(name: str) -> str:
    return f"((('0x' || substr(md5(id::VARCHAR || ':{name}:42'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _gauss(name: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(name + 'r')})) * cos(2 * pi() * {_uniform(name + 'a')}))"


_RING, _TURN = f"(2.0::DOUBLE * (id % 3 + 1) + {_gauss('r')} * 0.15::DOUBLE)", "(2 * pi() * (id % 5) / 5)"
_MOON, _SPIRAL = f"(pi() * {_uniform('t')})", f"(sqrt({_uniform('t')}) * 4 * pi())"
POINTS = {
    "unimodal": (500, _gauss("x"), _gauss("y")),
    "bimodal": (500, f"CASE WHEN id < 250 THEN -3 ELSE 3 END + {_gauss('x')} * 0.8::DOUBLE", f"{_gauss('y')} * 0.8::DOUBLE"),
    "multimodal": (500, f"5 * cos({_TURN}) + {_gauss('x')} * 0.5::DOUBLE", f"5 * sin({_TURN}) + {_gauss('y')} * 0.5::DOUBLE"),
    "concentric_rings": (600, f"{_RING} * cos(2 * pi() * {_uniform('a')})", f"{_RING} * sin(2 * pi() * {_uniform('a')})"),
    "moons": (500, f"CASE WHEN id % 2 = 0 THEN cos({_MOON}) ELSE 1 - cos({_MOON}) END + {_gauss('x')} * 0.1::DOUBLE", f"CASE WHEN id % 2 = 0 THEN sin({_MOON}) ELSE 0.5::DOUBLE - sin({_MOON}) END + {_gauss('y')} * 0.1::DOUBLE"),
    "spiral": (500, f"CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * {_SPIRAL} * cos({_SPIRAL}) / 3 + {_gauss('x')} * 0.1::DOUBLE", f"CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * {_SPIRAL} * sin({_SPIRAL}) / 3 + {_gauss('y')} * 0.1::DOUBLE"),
    "anisotropic": (500, f"2 * {_gauss('x')} + 1.5::DOUBLE * {_gauss('y')}", f"1.5::DOUBLE * {_gauss('x')} + 1.2::DOUBLE * {_gauss('y')}"),
    "uniform_square": (500, f"4 * {_uniform('x')} - 2", f"4 * {_uniform('y')} - 2"),
    "density_gradient": (500, f"-ln({_uniform('x')}) * 2", _gauss("y")),
    "clustered_outliers": (500, f"CASE WHEN id >= 475 THEN 8 + {_gauss('x')} * 0.3::DOUBLE ELSE {_gauss('x')} END", f"CASE WHEN id >= 475 THEN 8 + {_gauss('y')} * 0.3::DOUBLE ELSE {_gauss('y')} END"),
}
for _name, _make in generators.DISTRIBUTIONS.items():
    _n, _x, _y = POINTS[_name]
    add(f"gen_{_name}", lambda spark, d, f=_make: f(spark).select("id", rounded(F.col("e")[0], 6).alias("x"), rounded(F.col("e")[1], 6).alias("y")),
        f"SELECT id, round({_x}, 6) AS x, round({_y}, 6) AS y FROM (SELECT i AS id FROM range({_n}) r(i))")


# Streams --------------------------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row scores of the events table read as a stream, all that is there, into a table in the shared folder."""
    graph.ensure_checkpoints(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scored = scorers.row_score(stream, rounded(F.abs("value"), 6), "event_id")
    scored.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


add("stream_row_scores", _stream, "SELECT event_id AS id, round(abs(value), 6) AS score FROM events")
