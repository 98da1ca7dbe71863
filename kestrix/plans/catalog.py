"""Registered queries and their SQL equivalents.

Queries run the library's operators over rows of lineitem with their order and
part.  The SQL states the same result on its own; floats are rounded on both
sides because sums are added in another order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrix.functions import losses
from kestrix.operators import dataset, evaluate, indexing, mixed, normalize, scores
from kestrix.operators.config import Coordinate

QUERIES = {}
ORACLES = {}
FLAGSHIP = "grouped_auc"

#: The features of an example, in index order; the last is the intercept.
FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Fixed coefficients at which objectives and scores are compared.
BETA = (0.3, -0.2, 0.5, 0.1, -0.4)
DIRECTION = (0.1, 0.2, -0.3, 0.4, 0.5)

EXAMPLES_SQL = """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS uid,
           l_extendedprice / 10000 AS response, CAST(l_returnflag = 'R' AS INTEGER) * 1.0::DOUBLE AS label, l_quantity AS counts,
           o_totalprice / 1000000 AS "offset", 1 + (l_linenumber % 3) / 2.0::DOUBLE AS weight,
           l_suppkey AS supplier, o_custkey AS customer, l_partkey AS part,
           l_quantity / 50 AS x0, l_discount * 10 AS x1, p_size / 50.0::DOUBLE AS x2, l_tax * 10 AS x3, 1.0::DOUBLE AS x4,
           l_linestatus AS status, p_brand AS brand
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def examples(spark, sf_dir) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("uid"),
        (F.col("l_extendedprice") / 10000).alias("response"), (F.col("l_returnflag") == "R").cast("int").cast("double").alias("label"), F.col("l_quantity").alias("counts"),
        (F.col("o_totalprice") / 1000000).alias("offset"), (1 + (F.col("l_linenumber") % 3) / 2.0).alias("weight"),
        F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"),
        (F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"), (F.col("p_size") / 50.0).alias("x2"), (F.col("l_tax") * 10).alias("x3"), F.lit(1.0).alias("x4"),
        F.col("l_linestatus").alias("status"), F.col("p_brand").alias("brand"),
    )


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame with its SQL, which may read ex, the examples."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH ex AS ({EXAMPLES_SQL}), {sql.strip()[5:]}" if base and sql.strip().upper().startswith("WITH ") else f"WITH ex AS ({EXAMPLES_SQL}) {sql}" if base else sql
        return f

    return put


def _margin(beta=BETA):
    return sum((F.col(x) * b for x, b in zip(FEATURES, beta)), F.lit(0.0)) + F.col("offset")


_Z = " + ".join(f"{b} * {x}" for x, b in zip(FEATURES, BETA)) + ' + "offset"'
_SCORED = f'WITH s AS (SELECT *, {_Z} AS score FROM ex)'


def _scored(spark, sf_dir, label="label"):
    d = examples(spark, sf_dir).withColumn("score", _margin())
    return d.withColumn("label", F.col(label)) if label != "label" else d


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Rows ------------------------------------------------------------------------------------------

@query("labeled_examples", "SELECT uid, round(response, 6) AS response, label, weight, supplier FROM ex")
def labeled_examples(spark, sf_dir):
    return examples(spark, sf_dir).select("uid", F.round("response", 6).alias("response"), "label", "weight", "supplier")


@query("row_defaults", """SELECT uid, CAST(0.0 AS DOUBLE) AS "offset", CASE WHEN status = 'O' THEN CAST(1.0 AS DOUBLE) ELSE weight END AS weight, label, CAST(supplier AS VARCHAR) AS supplier FROM ex""")
def row_defaults(spark, sf_dir):
    d = examples(spark, sf_dir).withColumn("weight", F.when(F.col("status") != "O", F.col("weight"))).drop("offset").withColumn("features", F.array("x0"))
    got = dataset.examples(d.drop("response"), "features", ("supplier",), names={"response": "label"})
    return got.select("uid", "offset", "weight", "label", "supplier")


@query("id_tag_resolution", "SELECT uid, CAST(supplier AS VARCHAR) AS supplier, brand AS maker FROM ex")
def id_tag_resolution(spark, sf_dir):
    d = examples(spark, sf_dir).withColumn("metadataMap", F.create_map(F.lit("maker"), F.col("brand")))
    return d.select("uid", dataset.id_tag(d, "supplier").alias("supplier"), dataset.id_tag(d, "maker").alias("maker"))


_BROKEN = "CASE WHEN supplier % 7 = 0 THEN -1.0 ELSE {c} END"
for _task, _label, _bad in (
    ("LINEAR_REGRESSION", "response", "0"),
    ("LOGISTIC_REGRESSION", "label", "sum(CASE WHEN supplier % 7 = 0 THEN 1 ELSE 0 END)"),
    ("POISSON_REGRESSION", "counts", "sum(CASE WHEN supplier % 7 = 0 THEN 1 ELSE 0 END)"),
):

    @query(
        f"validate_{_task.split('_')[0].lower()}",
        f"SELECT CAST({_bad} AS BIGINT) AS label_invalid, CAST(0 AS BIGINT) AS offset_invalid, CAST(sum(CASE WHEN supplier % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS weight_invalid FROM ex",
    )
    def _validate(spark, sf_dir, task=_task, label=_label):
        d = examples(spark, sf_dir).withColumn("label", F.when(F.col("supplier") % 7 == 0, -1.0).otherwise(F.col(label)))
        return dataset.violations(d.withColumn("weight", F.when(F.col("supplier") % 5 == 0, 0.0).otherwise(F.col("weight"))), task, features=())


_LOSS_SQL = {
    "logistic": ("label", "CASE WHEN label > 0.5 THEN ln(1 + exp(-score)) ELSE ln(1 + exp(score)) END", "1 / (1 + exp(-score)) - label", "exp(score) / ((1 + exp(score)) * (1 + exp(score)))"),
    "squared": ("response", "(score - response) * (score - response) / 2", "score - response", "CAST(1.0 AS DOUBLE)"),
    "poisson": ("counts", "exp(score) - score * counts", "exp(score) - counts", "exp(score)"),
    "hinge": (
        "label",
        "CASE WHEN (2 * label - 1) * score <= 0 THEN 0.5 - (2 * label - 1) * score WHEN (2 * label - 1) * score < 1 THEN (1 - (2 * label - 1) * score) * (1 - (2 * label - 1) * score) / 2 ELSE 0 END",
        "(2 * label - 1) * CASE WHEN (2 * label - 1) * score <= 0 THEN -1 WHEN (2 * label - 1) * score < 1 THEN (2 * label - 1) * score - 1 ELSE 0 END", None,
    ),
}
_LOSSES = {"logistic": losses.LOGISTIC, "squared": losses.SQUARED, "poisson": losses.POISSON, "hinge": losses.HINGE}

for _name, (_y, _v, _d, _dd) in _LOSS_SQL.items():
    _loss = _LOSSES[_name]

    # margins have eight decimals: linear terms are rounded beyond them, where no value lies half-way
    _n, _m = {"squared": (7, 9), "hinge": (9, 9)}.get(_name, (6, 6))

    @query(f"loss_{_name}", f"{_SCORED} SELECT uid, round({_v}, {_n}) AS value, round({_d}, {_m}) AS first{f', round({_dd}, 6) AS second' if _dd else ''} FROM s")
    def _loss_rows(spark, sf_dir, loss=_loss, y=_y, n=_n, m=_m):
        z, label = F.col("score"), F.col(y)
        out = [F.round(loss.value(z, label), n).alias("value"), F.round(loss.first(z, label), m).alias("first")]
        if loss.second:
            out.append(F.round(loss.second(z, label), 6).alias("second"))
        return _scored(spark, sf_dir).select("uid", *out)

    @query(
        f"value_gradient_{_name}",
        f"{_SCORED}, d AS (SELECT *, {_v} AS v, {_d} AS g FROM s) SELECT round(sum(weight * v) / count(*), 7) AS value, "
        + ", ".join(f"round(sum(weight * g * {x}) / count(*), 7) AS g{i}" for i, x in enumerate(FEATURES)) + " FROM d",
    )
    def _value_gradient(spark, sf_dir, loss=_loss, y=_y):
        from kestrix.operators.objective import Distributed

        d = _vectors(spark, sf_dir, y)
        n = d.count()
        value, gradient = Distributed(loss, d, 5).value_gradient(np.array(BETA))
        return _round(spark.createDataFrame([(value / n, *map(float, gradient / n))], "value double, " + ", ".join(f"g{i} double" for i in range(5))), 7)


for _task, _sql in (("LOGISTIC_REGRESSION", "1 / (1 + exp(-score))"), ("POISSON_REGRESSION", "exp(score)")):

    @query(f"mean_function_{_task.split('_')[0].lower()}", f"{_SCORED} SELECT uid, round({_sql}, 7) AS prediction FROM s")
    def _mean(spark, sf_dir, task=_task):
        return _scored(spark, sf_dir).select("uid", F.round(losses.mean(task, F.col("score")), 7).alias("prediction"))


@query("classify_threshold", f"{_SCORED} SELECT uid, CAST(CASE WHEN round(1 / (1 + exp(-score)), 9) < 0.5 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS class FROM s")
def classify_threshold(spark, sf_dir):
    return _scored(spark, sf_dir).select("uid", losses.classify(F.round(losses.sigmoid(F.col("score")), 9)).alias("class"))


# Objectives at fixed coefficients ------------------------------------------------------------------

_CURVED = f"{_SCORED}, d AS (SELECT *, weight * {_LOSS_SQL['logistic'][3]} AS c FROM s)"


def _hessian(spark, sf_dir, names, of):
    """A row of values of an objective's second derivatives over the number of rows."""
    from kestrix.operators.objective import Distributed

    d = _vectors(spark, sf_dir)
    n = d.count()
    found = [float(v) / n for v in of(Distributed(losses.LOGISTIC, d, 5))]
    return _round(spark.createDataFrame([tuple(found)], ", ".join(f"{x} double" for x in names)), 7)


@query("hessian_diagonal", f"{_CURVED} SELECT " + ", ".join(f"round(sum(c * {x} * {x}) / count(*), 7) AS h{i}" for i, x in enumerate(FEATURES)) + " FROM d")
def hessian_diagonal(spark, sf_dir):
    return _hessian(spark, sf_dir, [f"h{i}" for i in range(5)], lambda o: o.hessian_diagonal(np.array(BETA)))


_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


@query("hessian_matrix", f"{_CURVED} SELECT " + ", ".join(f"round(sum(c * x{i} * x{j}) / count(*), 7) AS h{i}{j}" for i, j in _PAIRS) + " FROM d")
def hessian_matrix(spark, sf_dir):
    return _hessian(spark, sf_dir, [f"h{i}{j}" for i, j in _PAIRS], lambda o: (lambda h: [h[i, j] for i, j in _PAIRS])(o.hessian_matrix(np.array(BETA))))


_XD = " + ".join(f"{v} * {x}" for x, v in zip(FEATURES, DIRECTION))


@query("hessian_vector", f"{_CURVED} SELECT " + ", ".join(f"round(sum(c * ({_XD}) * {x}) / count(*), 7) AS h{i}" for i, x in enumerate(FEATURES)) + " FROM d")
def hessian_vector(spark, sf_dir):
    return _hessian(spark, sf_dir, [f"h{i}" for i in range(5)], lambda o: o.hessian_vector(np.array(BETA), np.array(DIRECTION)))


@query("penalty_terms", f"SELECT {sum(abs(b) for b in BETA) * 0.75!r}::DOUBLE AS l1, {sum(b * b for b in BETA[:4]) * 0.125!r}::DOUBLE AS l2, {sum((b - 0.1) ** 2 / 0.5 for b in BETA) / 2!r}::DOUBLE AS prior", False)
def penalty_terms(spark, sf_dir):
    from kestrix.operators.objective import Penalty

    b = np.array(BETA)
    c = Coordinate("g", regularization="ELASTIC_NET", alpha=0.75, weight=1.0)
    l2 = Penalty(c.l2, 4).value_gradient(b)[0]
    prior = Penalty(0.0, None, (np.full(5, 0.1), np.full(5, 0.5))).value_gradient(b)[0]
    return spark.createDataFrame([(float(c.l1 * np.abs(b).sum()), l2, prior)], "l1 double, l2 double, prior double").select(*(F.round(x, 9).alias(x) for x in ("l1", "l2", "prior")))


ORACLES["penalty_terms"] = f"SELECT round({sum(abs(b) for b in BETA) * 0.75!r}::DOUBLE, 9) AS l1, round({sum(b * b for b in BETA[:4]) * 0.125!r}::DOUBLE, 9) AS l2, round({sum((b - 0.1) ** 2 / 0.5 for b in BETA) / 2!r}::DOUBLE, 9) AS prior"


# Indexing, statistics and normalization ------------------------------------------------------------

def _bags(spark, sf_dir):
    d = examples(spark, sf_dir)
    f = lambda n, t, v: F.struct(F.lit(n).alias("name"), t.alias("term"), v.alias("value"))
    return d.select("uid", "label", F.array(f("brand", F.col("brand"), F.lit(1.0)), f("status", F.col("status"), F.lit(1.0)), f("quantity", F.lit(""), F.col("x0"))).alias("bag"))


_LONG = "WITH f AS (SELECT uid, 'brand' AS name, brand AS term, 1.0::DOUBLE AS val FROM ex UNION ALL SELECT uid, 'status', status, 1.0 FROM ex UNION ALL SELECT uid, 'quantity', '', x0 FROM ex), i AS (SELECT name, term, row_number() OVER (ORDER BY name || chr(1) || term) - 1 AS idx FROM (SELECT DISTINCT name, term FROM f))"


@query("feature_index", f"{_LONG} SELECT name, term, CAST(idx AS INTEGER) AS idx FROM i UNION ALL SELECT '(INTERCEPT)', '', CAST(count(*) AS INTEGER) FROM i")
def feature_index(spark, sf_dir):
    from kestrix.functions.features import key, name_of, term_of

    words = indexing.vocabulary(_bags(spark, sf_dir), ["bag"])
    idx = indexing.index(words.select(key(F.col("name"), F.col("term")).alias("key")), True)
    return idx.select(name_of(F.col("key")).alias("name"), term_of(F.col("key")).alias("term"), "idx")


@query("bag_vocabulary", f"{_LONG} SELECT DISTINCT name, term FROM f")
def bag_vocabulary(spark, sf_dir):
    return indexing.vocabulary(_bags(spark, sf_dir), ["bag"])


@query("merged_shard_long", f"{_LONG} SELECT uid, CAST(idx AS INTEGER) AS idx, round(val, 6) AS val FROM f JOIN i USING (name, term) UNION ALL SELECT uid, (SELECT CAST(count(*) AS INTEGER) FROM i), 1.0 FROM ex")
def merged_shard_long(spark, sf_dir):
    from kestrix.operators.config import Shard
    from kestrix.sources.readers import read_merged

    out, _ = read_merged(_bags(spark, sf_dir), [Shard("s", ("bag",))])
    return out.select("uid", F.explode("s").alias("x")).select("uid", F.col("x.idx").alias("idx"), F.round("x.val", 6).alias("val"))


@query("duplicate_features", "SELECT uid, brand AS term, CAST(2 AS BIGINT) AS n FROM ex WHERE brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
def duplicate_features(spark, sf_dir):
    from kestrix.functions.features import term_of

    d = _bags(spark, sf_dir).withColumn("again", F.filter("bag", lambda x: x["term"].isin("Brand#11", "Brand#22", "Brand#33")))
    return indexing.duplicates(d, ["bag", "again"]).select("uid", term_of(F.col("key")).alias("term"), "n")


def _vectors(spark, sf_dir, label="label"):
    from kestrix.functions.features import dense

    d = examples(spark, sf_dir)
    return d.select("uid", F.col(label).alias("label"), "offset", "weight", "supplier", "customer", F.filter(dense(*FEATURES), lambda x: x["val"] != 0).alias("features"))


_STATS = "WITH l AS (" + " UNION ALL ".join(f"SELECT {i} AS idx, {x} AS v FROM ex" for i, x in enumerate(FEATURES)) + "), t AS (SELECT idx, count(*) AS count, avg(v) AS mean, CASE WHEN var_samp(v) > 0 THEN var_samp(v) ELSE 1.0 END AS variance, sum(CAST(v <> 0 AS INTEGER)) AS nnz, max(v) AS max, min(v) AS min, sum(abs(v)) AS norm_l1, sqrt(sum(v * v)) AS norm_l2, avg(abs(v)) AS mean_abs FROM l GROUP BY idx)"


@query("feature_statistics", f"{_STATS} SELECT CAST(idx AS INTEGER) AS idx, count, round(mean, 7) AS mean, round(CASE WHEN idx = 4 THEN 1.0 ELSE variance END, 7) AS variance, CAST(nnz AS BIGINT) AS nnz, round(max, 7) AS max, round(min, 7) AS min, round(norm_l1, 4) AS norm_l1, round(norm_l2, 4) AS norm_l2, round(mean_abs, 7) AS mean_abs FROM t")
def feature_statistics(spark, sf_dir):
    d = normalize.statistics(_vectors(spark, sf_dir))
    return d.select("idx", "count", *(F.round(c, 7).alias(c) for c in ("mean",)), F.round("variance", 7).alias("variance"), "nnz", F.round("max", 7).alias("max"), F.round("min", 7).alias("min"), F.round("norm_l1", 4).alias("norm_l1"), F.round("norm_l2", 4).alias("norm_l2"), F.round("mean_abs", 7).alias("mean_abs"))


for _kind, _sql in ((normalize.SCALE_STD, "1 / sqrt(CASE WHEN idx = 4 THEN 1.0 ELSE variance END)"), (normalize.SCALE_MAX, "CASE WHEN greatest(abs(max), abs(min)) = 0 THEN 1.0 ELSE 1 / greatest(abs(max), abs(min)) END")):

    @query(f"norm_factors_{'std' if _kind == normalize.SCALE_STD else 'max'}", f"{_STATS} SELECT CAST(idx AS INTEGER) AS idx, round({_sql}, 7) AS factor FROM t")
    def _factors(spark, sf_dir, kind=_kind):
        d = normalize.statistics(_vectors(spark, sf_dir))
        return d.select("idx", F.round(normalize.factor(kind, F.col("variance"), F.col("max"), F.col("min")), 7).alias("factor"))


@query(
    "coef_to_original_space",
    f"{_STATS}, b AS (SELECT idx, CASE idx " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BETA)) + " END AS b, CASE WHEN idx = 4 THEN 1.0 ELSE 1 / sqrt(variance) END AS f, CASE WHEN idx = 4 THEN 0.0 ELSE mean END AS m FROM t) "
    "SELECT CAST(idx AS INTEGER) AS idx, round(b * f - CASE WHEN idx = 4 THEN (SELECT sum(b * f * m) FROM b) ELSE 0 END, 6) AS coefficient FROM b",
)
def coef_to_original_space(spark, sf_dir):
    norm = normalize.Normalization.build(normalize.STANDARDIZATION, normalize.statistics(_vectors(spark, sf_dir)), 5, 4)
    rows = [(i, float(v)) for i, v in enumerate(norm.to_original(np.array(BETA)))]
    return spark.createDataFrame(rows, "idx int, c double").select("idx", F.round("c", 6).alias("coefficient"))


# Entities and sampling ------------------------------------------------------------------------------

@query("entity_counts", "SELECT supplier, count(*) AS n FROM ex GROUP BY supplier")
def entity_counts(spark, sf_dir):
    return dataset.entity_counts(examples(spark, sf_dir), "supplier")


_RANKED = "WITH r AS (SELECT *, count(*) OVER (PARTITION BY supplier) AS n, row_number() OVER (PARTITION BY supplier ORDER BY md5('s#' || uid) DESC, uid) AS r FROM ex)"


def _split(spark, sf_dir):
    return dataset.active_passive(examples(spark, sf_dir), "supplier", "s", 100, 50)


@query("active_capped_reweighted", f"{_RANKED} SELECT uid, supplier, round(weight * CASE WHEN n > 100 THEN n / 100.0 ELSE 1 END, 7) AS weight FROM r WHERE n >= 50 AND r <= 100")
def active_capped_reweighted(spark, sf_dir):
    return _split(spark, sf_dir).where("active").select("uid", "supplier", F.round("weight", 7).alias("weight"))


@query("passive_rows", f"{_RANKED} SELECT uid, supplier, weight FROM r WHERE n >= 50 AND r > 100")
def passive_rows(spark, sf_dir):
    return _split(spark, sf_dir).where("NOT active").select("uid", "supplier", "weight")


@query("active_lower_bound", "WITH k AS (SELECT customer, count(*) AS n FROM ex GROUP BY customer) SELECT uid, ex.customer FROM ex JOIN k USING (customer) WHERE n >= 40 OR customer % 2 = 1")
def active_lower_bound(spark, sf_dir):
    d = examples(spark, sf_dir)
    known = d.where("customer % 2 = 0").select("customer").distinct()
    return dataset.active_passive(d, "customer", bound=40, existing=known).select("uid", "customer")


@query("active_feature_sets", "WITH l AS (" + " UNION ALL ".join(f"SELECT supplier, {i} AS idx FROM ex WHERE {x} <> 0" for i, x in enumerate(FEATURES)) + ") SELECT DISTINCT supplier, CAST(idx AS INTEGER) AS idx FROM l")
def active_feature_sets(spark, sf_dir):
    return dataset.feature_sets(_vectors(spark, sf_dir), "supplier")


_CORR = "WITH l AS (" + " UNION ALL ".join(f"SELECT supplier, label, {i} AS idx, {x} AS v FROM ex" for i, x in enumerate(FEATURES)) + "), c AS (SELECT supplier, idx, count(*) AS n, CASE WHEN idx = 4 THEN 1.0 ELSE coalesce(corr(v, label), 0) END AS r FROM l GROUP BY supplier, idx)"


@query("pearson_by_entity", f"{_CORR} SELECT supplier, CAST(idx AS INTEGER) AS idx, round(r, 6) AS correlation FROM c")
def pearson_by_entity(spark, sf_dir):
    return dataset.feature_scores(_vectors(spark, sf_dir), "supplier").select("supplier", "idx", F.round("correlation", 6).alias("correlation"))


@query("feature_selection_by_ratio", f"{_CORR}, k AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY round(abs(r), 9) DESC, idx) AS p FROM c) SELECT supplier, CAST(idx AS INTEGER) AS idx FROM k WHERE p <= ceil(0.005 * n)")
def feature_selection_by_ratio(spark, sf_dir):
    scores = dataset.feature_scores(_vectors(spark, sf_dir), "supplier").withColumn("correlation", F.round("correlation", 9))
    return dataset.select_features(scores, "supplier", 0.005)


_DRAW = "CAST(('0x' || substr(md5('7#' || uid), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("downsample_binary_hash", f"SELECT uid, label, CASE WHEN label >= 0.5 THEN weight ELSE weight / 0.25 END AS weight FROM ex WHERE label >= 0.5 OR {_DRAW} < 0.25")
def downsample_binary(spark, sf_dir):
    return dataset.down_sample(examples(spark, sf_dir), 0.25, "LOGISTIC_REGRESSION", 7, F.col("uid")).select("uid", "label", "weight")


@query("downsample_default_hash", f"SELECT uid, weight FROM ex WHERE {_DRAW} < 0.25")
def downsample_default(spark, sf_dir):
    return dataset.down_sample(examples(spark, sf_dir), 0.25, "LINEAR_REGRESSION", 7, F.col("uid")).select("uid", "weight")


# Scores and residuals --------------------------------------------------------------------------------

def _entity_models(spark, sf_dir):
    """A bias for every even supplier; the others have no model."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0")
    return s.select(F.col("s_suppkey").alias("supplier"), F.array(F.struct(F.lit(4).alias("idx"), (F.col("s_acctbal") / 10000).alias("mean"), F.lit(None).cast("double").alias("variance"))).alias("coefficients"))


_RE = "WITH m AS (SELECT s_suppkey AS supplier, s_acctbal / 10000 AS bias FROM supplier WHERE s_suppkey % 2 = 0)"
_FIXED = " + ".join(f"{b} * {x}" for x, b in zip(FEATURES, BETA))


@query("score_fixed", f"SELECT uid, round({_FIXED}, 7) AS score FROM ex")
def score_fixed(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    return d.select("uid", F.round(mixed.FixedModel("features", np.array(BETA)).score(d), 7).alias("score"))


@query("score_random_left_join", f"{_RE} SELECT uid, round(coalesce(bias, 0), 7) AS score FROM ex LEFT JOIN m USING (supplier)")
def score_random(spark, sf_dir):
    m = mixed.RandomModel("features", "supplier", _entity_models(spark, sf_dir))
    return m.scored(_vectors(spark, sf_dir), "score").select("uid", F.round("score", 7).alias("score"))


@query("score_game_sum", f'{_RE} SELECT uid, round({_FIXED} + coalesce(bias, 0) + "offset", 9) AS score FROM ex LEFT JOIN m USING (supplier)')
def score_sum(spark, sf_dir):
    m = mixed.MixedModel("LOGISTIC_REGRESSION", {"g": mixed.FixedModel("features", np.array(BETA)), "r": mixed.RandomModel("features", "supplier", _entity_models(spark, sf_dir))})
    return m.score(_vectors(spark, sf_dir)).select("uid", F.round("score", 9).alias("score"))


@query("scores_plus_minus", "WITH a AS (SELECT uid, x0 AS s FROM ex WHERE supplier % 3 <> 0), b AS (SELECT uid, x2 AS s FROM ex WHERE supplier % 3 <> 1) SELECT uid, round(coalesce(a.s, 0) + coalesce(b.s, 0), 7) AS plus, round(coalesce(a.s, 0) - coalesce(b.s, 0), 7) AS minus FROM a FULL JOIN b USING (uid)")
def scores_plus_minus(spark, sf_dir):
    d = examples(spark, sf_dir)
    a, b = d.where("supplier % 3 <> 0").select("uid", F.col("x0").alias("score")), d.where("supplier % 3 <> 1").select("uid", F.col("x2").alias("score"))
    both = scores.plus(a, b).withColumnRenamed("score", "plus").join(scores.minus(a, b).withColumnRenamed("score", "minus"), "uid")
    return both.select("uid", F.round("plus", 7).alias("plus"), F.round("minus", 7).alias("minus"))


@query("offsets_with_residuals", f'{_RE} SELECT uid, round("offset" + coalesce(bias, 0), 9) AS "offset" FROM ex LEFT JOIN m USING (supplier)')
def offsets_with_residuals(spark, sf_dir):
    m = mixed.RandomModel("features", "supplier", _entity_models(spark, sf_dir))
    return m.scored(_vectors(spark, sf_dir), "s").select("uid", F.round(F.col("offset") + F.col("s"), 9).alias("offset"))


# Metrics ------------------------------------------------------------------------------------------------

_TIES = f"WITH s AS (SELECT uid, supplier, label, weight, round({_Z}, 2) AS score FROM ex)"
_RUN = ", t AS (SELECT {k}score, sum({p}) AS p, sum({q}) AS q FROM s GROUP BY {k}score), c AS (SELECT *, sum(p) OVER ({w}ORDER BY score DESC) AS cp, sum(q) OVER ({w}ORDER BY score DESC) AS cq FROM t)"
_ONE = _RUN.format(k="", p="label", q="1 - label", w="")
_BY = _RUN.format(k="supplier, ", p="weight * label", q="weight * (1 - label)", w="PARTITION BY supplier ")


def _tied(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 2))


@query("auc", f"{_TIES}{_ONE} SELECT round(sum(q * (cp - p / 2)) / (sum(p) * sum(q)), 7) AS auc FROM c")
def auc(spark, sf_dir):
    return _round(evaluate.auc(_tied(spark, sf_dir)), 7)


@query("aupr", f"{_TIES}{_ONE} SELECT round(sum(p * (cp / (cp + cq) + CASE WHEN cp + cq = p + q THEN cp / (cp + cq) ELSE (cp - p) / (cp + cq - p - q) END) / 2) / sum(p), 7) AS aupr FROM c")
def aupr(spark, sf_dir):
    return _round(evaluate.aupr(_tied(spark, sf_dir)), 7)


@query("peak_f1", f"{_TIES}{_ONE} SELECT round(max(2 * cp / (cp + cq + (SELECT sum(p) FROM t))), 7) AS peak_f1 FROM c")
def peak_f1(spark, sf_dir):
    return _round(evaluate.peak_f1(_tied(spark, sf_dir)), 7)


@query("grouped_auc", f"{_TIES}{_BY}, g AS (SELECT CASE WHEN sum(p) * sum(q) > 0 THEN sum(q * (cp - p / 2)) / (sum(p) * sum(q)) END AS auc FROM c GROUP BY supplier) SELECT round(coalesce(avg(auc), 0), 7) AS auc FROM g")
def grouped_auc(spark, sf_dir):
    return _round(evaluate.group_mean(evaluate.grouped_auc(_tied(spark, sf_dir), "supplier"), "auc"), 7)


@query("grouped_auc_per_group", f"{_TIES}{_BY} SELECT supplier, round(CASE WHEN sum(p) * sum(q) > 0 THEN sum(q * (cp - p / 2)) / (sum(p) * sum(q)) END, 7) AS auc FROM c GROUP BY supplier")
def grouped_auc_per_group(spark, sf_dir):
    return _round(evaluate.grouped_auc(_tied(spark, sf_dir), "supplier"), 7)


@query("precision_at_k", f"{_TIES}, r AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY score DESC, uid) AS r FROM s) SELECT supplier, sum(label) / 10 AS precision FROM r WHERE r <= 10 GROUP BY supplier")
def precision_at_k(spark, sf_dir):
    return evaluate.precision_at_k(_tied(spark, sf_dir), "supplier", 10)


@query("precision_at_k_mean", f"{_TIES}, r AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY score DESC, uid) AS r FROM s), g AS (SELECT sum(label) / 10 AS p FROM r WHERE r <= 10 GROUP BY supplier) SELECT round(avg(p), 9) AS precision FROM g")
def precision_at_k_mean(spark, sf_dir):
    return _round(evaluate.group_mean(evaluate.precision_at_k(_tied(spark, sf_dir), "supplier", 10), "precision"), 9)


for _metric, _label, _sql in (
    ("rmse", "response", "sqrt(sum(weight * (score - response) * (score - response)) / count(*))"),
    ("squared_loss", "response", "sum(weight * (score - response) * (score - response)) / 1000"),
    ("logistic_loss", "label", f"sum(weight * ({_LOSS_SQL['logistic'][1]})) / 1000"),
    ("poisson_loss", "counts", f"sum(weight * ({_LOSS_SQL['poisson'][1]})) / 1000"),
    ("smoothed_hinge_loss", "label", f"sum(weight * ({_LOSS_SQL['hinge'][1]})) / 1000"),
):

    @query(_metric, f"{_SCORED} SELECT round({_sql}, 5) AS value FROM s")
    def _metric_query(spark, sf_dir, metric=_metric, label=_label):
        scale = 1.0 if metric == "rmse" else 1000.0
        return _scored(spark, sf_dir, label).agg(F.round(evaluate._SUMS[metric.upper()]() / scale, 5).alias("value"))


@query("mae_mse", f"{_SCORED} SELECT round(avg(abs(score - response)), 6) AS mae, round(avg((score - response) * (score - response)), 6) AS mse, round(sqrt(avg((score - response) * (score - response))), 6) AS rmse FROM s")
def mae_mse(spark, sf_dir):
    return _round(evaluate.regression_metrics(_scored(spark, sf_dir, "response")))


@query("log_likelihood_poisson", f"{_SCORED} SELECT round(avg(-({_LOSS_SQL['poisson'][1]}) - lgamma(counts + 1)), 6) AS log_likelihood FROM s")
def log_likelihood_poisson(spark, sf_dir):
    return _round(evaluate.log_likelihood(_scored(spark, sf_dir, "counts"), "POISSON_REGRESSION"))


@query("aic", f"{_SCORED}, l AS (SELECT -sum({_LOSS_SQL['logistic'][1]}) AS ll, count(*) AS n FROM s) SELECT round((2 * (5 - ll) + 2 * 5 * 6.0 / (n - 5 - 1)) / n, 7) AS aic FROM l")
def aic(spark, sf_dir):
    d = evaluate.log_likelihood(_scored(spark, sf_dir), "LOGISTIC_REGRESSION")
    n = _scored(spark, sf_dir).count()
    value = evaluate.aic(d.first()[0] * n, 5, n) / n
    return spark.createDataFrame([(value,)], "aic double").select(F.round("aic", 7).alias("aic"))


# Training with a closed form --------------------------------------------------------------------------

_LIN = "WITH q AS (SELECT sum(weight * x0 * x0) + 2 AS a, sum(weight * x0) AS b, sum(weight) AS c, sum(weight * x0 * (response - \"offset\")) AS d, sum(weight * (response - \"offset\")) AS e FROM ex)"


def _two(spark, sf_dir, label="response"):
    from kestrix.functions.features import dense

    d = examples(spark, sf_dir)
    return d.select("uid", F.col(label).alias("label"), "offset", "weight", "supplier", dense("x0", "x4").alias("features"), dense("x4").alias("bias"))


for _opt in ("LBFGS", "TRON"):

    @query(f"ridge_closed_form_{_opt.lower()}", f"{_LIN} SELECT round((d * c - b * e) / (a * c - b * b), 5) AS slope, round((a * e - b * d) / (a * c - b * b), 5) AS intercept FROM q")
    def _ridge(spark, sf_dir, opt=_opt):
        c = mixed.FixedCoordinate(Coordinate("g", optimizer=opt, regularization="L2", weight=2.0, tolerance=1e-13, max_iterations=100), "LINEAR_REGRESSION", 2, intercept=1)
        m = c.train(_two(spark, sf_dir), F.col("offset"))
        return spark.createDataFrame([tuple(map(float, m.means))], "a double, b double").select(F.round("a", 5).alias("slope"), F.round("b", 5).alias("intercept"))


@query("per_entity_ridge", 'SELECT CAST(supplier AS VARCHAR) AS supplier, round(sum(weight * (response - "offset")) / (sum(weight) + 2), 6) AS bias FROM ex GROUP BY supplier')
def per_entity_ridge(spark, sf_dir):
    c = mixed.RandomCoordinate(Coordinate("r", "bias", "supplier", regularization="L2", weight=2.0, tolerance=1e-12), "LINEAR_REGRESSION")
    m = c.train(c.rows(_two(spark, sf_dir)), F.col("offset"))
    return m.table.select("supplier", F.round(F.col("coefficients")[0]["mean"], 6).alias("bias"))


@query(
    "residual_pass",
    "WITH f AS (SELECT sum(weight * (response - \"offset\")) / sum(weight) AS b FROM ex), r AS (SELECT supplier, sum(weight * (response - \"offset\" - b)) / (sum(weight) + 2) AS bias FROM ex, f GROUP BY supplier) SELECT uid, round(b + bias + \"offset\", 3) AS score FROM ex JOIN r USING (supplier), f",
)
def residual_pass(spark, sf_dir):
    d = _two(spark, sf_dir).withColumn("supplier", F.col("supplier").cast("string"))
    coords = {"g": Coordinate("g", "bias", tolerance=1e-13), "r": Coordinate("r", "bias", "supplier", regularization="L2", weight=2.0, tolerance=1e-12)}
    parts = {"g": mixed.FixedCoordinate(coords["g"], "LINEAR_REGRESSION", 1), "r": mixed.RandomCoordinate(coords["r"], "LINEAR_REGRESSION")}
    out = mixed.descend(d, parts, "LINEAR_REGRESSION")
    return out.model.score(d).select("uid", F.round("score", 3).alias("score"))


_H = f"{_CURVED}, h AS (SELECT sum(c * x0 * x0) AS a, sum(c * x0 * x4) AS b, sum(c * x4 * x4) AS d FROM (SELECT weight * exp(z) / ((1 + exp(z)) * (1 + exp(z))) AS c, x0, x4 FROM (SELECT *, 0.3 * x0 - 0.4 * x4 + \"offset\" AS z FROM ex)))"
for _kind, _sql in (("SIMPLE", "1 / a AS v0, 1 / d AS v1"), ("FULL", "d / (a * d - b * b) AS v0, a / (a * d - b * b) AS v1")):

    @query(f"variance_{_kind.lower()}", f"{_H}, v AS (SELECT {_sql} FROM h) SELECT round(v0 * 1000, 6) AS v0, round(v1 * 1000, 6) AS v1 FROM v")
    def _variance(spark, sf_dir, kind=_kind):
        from kestrix.operators.objective import Distributed, variances

        o = Distributed(losses.LOGISTIC, _two(spark, sf_dir, "label"), 2)
        v = variances(o, np.array([0.3, -0.4]), kind) * 1000
        return spark.createDataFrame([tuple(map(float, v))], "a double, b double").select(F.round("a", 6).alias("v0"), F.round("b", 6).alias("v1"))


# Training without a closed form; tests hold these by their own properties ---------------------------

def _trained(spark, sf_dir, task, label, **config) -> DataFrame:
    c = mixed.FixedCoordinate(Coordinate("g", **config), task, 5, intercept=4)
    m = c.train(_vectors(spark, sf_dir, label), F.col("offset"))
    rows = [(i, float(v), c.result.reason) for i, v in enumerate(m.means)]
    return spark.createDataFrame(rows, "idx int, coefficient double, reason string")


for _name, _task, _label, _config in (
    ("logistic_lbfgs", "LOGISTIC_REGRESSION", "label", {"regularization": "L2", "weight": 1.0}),
    ("poisson_tron", "POISSON_REGRESSION", "counts", {"optimizer": "TRON", "regularization": "L2", "weight": 1.0}),
    ("svm_lbfgs", "SMOOTHED_HINGE_LOSS_LINEAR_SVM", "label", {"regularization": "L2", "weight": 1.0}),
    ("elastic_net_owlqn", "LOGISTIC_REGRESSION", "label", {"regularization": "ELASTIC_NET", "alpha": 0.5, "weight": 50.0}),
    ("box_constrained", "LOGISTIC_REGRESSION", "label", {"bounds": {0: (-0.05, 0.05), 2: (0.0, 0.1)}}),
):

    @query(_name)
    def _train(spark, sf_dir, task=_task, label=_label, config=_config):
        return _trained(spark, sf_dir, task, label, **config)


@query("regularization_path")
def regularization_path(spark, sf_dir):
    d = _vectors(spark, sf_dir).persist()
    path = mixed.regularization_path(d, Coordinate("g", regularization="L2"), "LOGISTIC_REGRESSION", [1000.0, 10.0, 0.1], size=5, intercept=4)
    return spark.createDataFrame([(w, i, float(v)) for w, m, _ in path for i, v in enumerate(m.means)], "lambda double, idx int, coefficient double")


def _game(spark, sf_dir, **options):
    from kestrix.functions.features import dense

    d = examples(spark, sf_dir).select("uid", "label", "offset", "weight", F.col("supplier").cast("string").alias("supplier"), F.col("customer").cast("string").alias("customer"), dense(*FEATURES).alias("features"), dense("x0", "x4").alias("small"))
    coords = [
        Coordinate("global", regularization="L2", weights=(1.0,), max_iterations=20),
        Coordinate("per-supplier", "small", "supplier", regularization="L2", weights=(10.0,), optimizer="TRON", max_iterations=10, cap=500),
        Coordinate("per-customer", "small", "customer", regularization="L2", weights=(10.0,), max_iterations=10, bound=5),
    ]
    return d, mixed.Estimator("LOGISTIC_REGRESSION", coords, **options)


@query("game_descent")
def game_descent(spark, sf_dir):
    d, est = _game(spark, sf_dir, passes=2, evaluators=["AUC", "LOGISTIC_LOSS", "AUC:supplier"])
    held, d = F.crc32(F.col("uid").cast("binary")) % 5 == 0, mixed.kept(d)
    out = est.fit(d.where(~held), d.where(held))[0][1]
    mixed.dropped(d)
    return spark.createDataFrame([(h["pass"], h["coordinate"], h["AUC"], h["LOGISTIC_LOSS"], h["AUC:supplier"]) for h in out.history], "pass int, coordinate string, auc double, logistic_loss double, auc_supplier double")


@query("partial_retrain")
def partial_retrain(spark, sf_dir):
    d, est = _game(spark, sf_dir)
    first = mixed.FixedModel("features", np.array(BETA))
    est.initial, est.locked = mixed.MixedModel("LOGISTIC_REGRESSION", {"global": first}), ("global",)
    d = mixed.kept(d)
    return est.fit(d)[0][1].model.score(d).select("uid", "score")


@query("incremental_prior")
def incremental_prior(spark, sf_dir):
    d = _vectors(spark, sf_dir).persist()
    c = [Coordinate("global", regularization="L2", weights=(1.0,))]
    old = mixed.Estimator("LOGISTIC_REGRESSION", c, variance="SIMPLE").fit(d.where("supplier % 2 = 0"))[0][1].model
    new = mixed.Estimator("LOGISTIC_REGRESSION", c, variance="SIMPLE", initial=old, incremental=True).fit(d.where("supplier % 2 = 1"))[0][1].model
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(old.models["global"].means, new.models["global"].means))]
    return spark.createDataFrame(rows, "idx int, before double, after double")


for _mode in ("RANDOM", "BAYESIAN"):

    @query(f"tuning_{_mode.lower()}")
    def _tune(spark, sf_dir, mode=_mode):
        from kestrix.operators import tuning

        d = _vectors(spark, sf_dir)
        train, test = d.where("supplier % 4 <> 0").persist(), d.where("supplier % 4 = 0").persist()
        base = {"global": Coordinate("global", regularization="L2", max_iterations=8)}
        est = mixed.Estimator("LOGISTIC_REGRESSION", list(base.values()), evaluators=["LOGISTIC_LOSS"])
        f = tuning.EstimatorFunction(est, base, train, test, False)
        found = tuning.search(4, f.dimensions, mode, f)
        return spark.createDataFrame([(f.configuration(x)["global"].weight, float(v)) for x, v, _ in found], "weight double, logistic_loss double")


@query("training_summary", 'SELECT count(*) AS rows, round(sum(weight), 4) AS weight_sum, round(sum(label), 4) AS label_sum, round(avg(CAST((x0 <> 0)::INT + (x1 <> 0)::INT + (x2 <> 0)::INT + (x3 <> 0)::INT + 1 AS DOUBLE)), 7) AS mean_features FROM ex')
def training_summary(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    return dataset.fixed_summary(d).select("rows", F.round("weight_sum", 4).alias("weight_sum"), F.round("label_sum", 4).alias("label_sum"), F.round("mean_features", 7).alias("mean_features"))


@query("coefficients_by_size", "SELECT CAST(i AS INTEGER) AS idx, b AS value, CAST(row_number() OVER (ORDER BY abs(b) DESC) AS INTEGER) AS rank FROM (VALUES " + ", ".join(f"({i}, {b}::DOUBLE)" for i, b in enumerate(BETA)) + ") AS t(i, b) WHERE abs(b) > 0.15", False)
def sized_coefficients(spark, sf_dir):
    from kestrix.sources.writers import coefficients_by_size

    d = spark.createDataFrame([(i, b) for i, b in enumerate(BETA)], "idx int, value double")
    return coefficients_by_size(d, 0.15)


from . import catalog_jobs  # noqa: E402, F401  registers its queries here
