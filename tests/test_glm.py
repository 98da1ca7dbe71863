import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrix.functions import losses, optim
from kestrix.functions.features import VECTOR
from kestrix.operators import dataset, evaluate, mixed, normalize
from kestrix.operators.config import Coordinate, Shard, grid
from kestrix.operators.objective import Distributed, Local, Penalty, Sparse, variances

# Ten labelled points and what they give.
POINTS = [
    (0, -0.7306653538519616, 0.0), (1, 0.6750417712898752, -0.4232874171873786), (1, 0.1863463229359709, -0.8163423997075965), (0, -0.6719842051493347, 0.0),
    (1, 0.9699938346531928, 0.0), (1, 0.22759406190283604, 0.0), (1, 0.9688721028330911, 0.0), (0, 0.5993795346650845, 0.0), (0, 0.9219423508390701, -0.8972778242305388),
    (0, 0.7006904841584055, -0.5607635619919824),
]
RIDGE = [0.3215554473500486, 0.17904355431985355, 0.4122241763914806]
PLAIN = [0.34945501725815586, 0.26339479490270173, 0.4366125400310442]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(y), 0.0, 1.0, [(0, a), (1, b), (2, 1.0)], "e%d" % (i % 2)) for i, (y, a, b) in enumerate(POINTS)]
    return spark.createDataFrame(rows, f"uid long, label double, offset double, weight double, features {VECTOR}, ent string").cache()


def dense(x):
    n, d = x.shape
    return Sparse(n, np.repeat(np.arange(n), d), np.tile(np.arange(d), n), x.ravel())


def test_ridge_golden(points):
    for opt, tol in (("LBFGS", 1e-12), ("TRON", 1e-12)):
        c = mixed.FixedCoordinate(Coordinate("g", optimizer=opt, regularization="L2", weight=0.3, tolerance=tol, max_iterations=100), "LINEAR_REGRESSION", 3)
        m = c.train(points, F.col("offset"))
        assert np.allclose(m.means, RIDGE, atol=1e-7), (opt, m.means)


@pytest.mark.parametrize("kind", [normalize.NONE, normalize.SCALE_MAX, normalize.SCALE_STD, normalize.STANDARDIZATION])
def test_normalization_leaves_the_solution(points, kind):
    stats = normalize.statistics(points)
    norm = normalize.Normalization.build(kind, stats, 3, 2)
    c = mixed.FixedCoordinate(Coordinate("g", tolerance=1e-13, max_iterations=200), "LINEAR_REGRESSION", 3, norm, 2)
    assert np.allclose(c.train(points, F.col("offset")).means, PLAIN, atol=1e-6)


def test_statistics_golden(points):
    got = {r["idx"]: r for r in normalize.statistics(points).collect()}
    assert np.allclose([got[0]["mean"], got[1]["mean"]], [0.3847210904276229, -0.26976712031174965])
    assert np.allclose([got[0]["variance"], got[1]["variance"]], [0.40303763661250336, 0.13748971393448942])
    assert np.allclose([got[0]["norm_l1"], got[1]["norm_l2"]], [6.652510022278823, 1.401838227979015])
    assert got[2]["variance"] == 1.0 and got[1]["nnz"] == 4


def test_statistics_count_absent_entries_as_zero(spark):
    df = spark.createDataFrame([([(0, 2.0)],), ([],), ([(0, 4.0)],)], f"features {VECTOR}")
    r = normalize.statistics(df).first()
    x = np.array([2.0, 0, 4])
    assert np.allclose([r["mean"], r["variance"], r["max"], r["min"]], [x.mean(), x.var(ddof=1), 4, 0])


@pytest.mark.parametrize("loss", [losses.LOGISTIC, losses.SQUARED, losses.POISSON, losses.HINGE])
def test_derivatives(loss):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 4)), (rng.random(40) > 0.5).astype(float)
    norm = normalize.Normalization(np.array([1.0, 2, 0.5, 1]), np.array([0.1, -0.2, 0.3, 0]), 3) if loss.np_second else normalize.Normalization()
    o = Local(loss, dense(x), y, rng.normal(size=40), rng.random(40), 4, Penalty(0.7, 3), norm)
    b, e = rng.normal(size=4), 1e-6
    _, g = o.value_gradient(b)
    for j in range(4):
        d = np.eye(4)[j] * e
        assert abs((o.value_gradient(b + d)[0] - o.value_gradient(b - d)[0]) / (2 * e) - g[j]) < 1e-3
        if loss.np_second:
            assert np.allclose((o.value_gradient(b + d)[1] - o.value_gradient(b - d)[1]) / (2 * e), o.hessian_vector(b, np.eye(4)[j]), atol=1e-3)


def test_distributed_equals_local(points):
    x = np.array([[a, b, 1.0] for _, a, b in POINTS])
    y = np.array([p[0] for p in POINTS], float)
    b = np.array([0.3, -0.2, 0.1])
    one = Local(losses.LOGISTIC, dense(x), y, np.zeros(10), np.ones(10), 3, Penalty(0.5, 2))
    two = Distributed(losses.LOGISTIC, points.repartition(3), 3, Penalty(0.5, 2))
    two.many = True
    assert np.allclose(one.value_gradient(b)[1], two.value_gradient(b)[1]) and np.allclose(one.hessian_vector(b, b), two.hessian_vector(b, b))
    assert np.allclose(one.hessian_matrix(b), two.hessian_matrix(b)) and np.allclose(np.diag(one.hessian_matrix(b)), two.hessian_diagonal(b))
    assert np.allclose(variances(one, b, "FULL"), np.diag(np.linalg.inv(one.hessian_matrix(b))))
    assert np.allclose(variances(one, b, "SIMPLE"), 1 / np.diag(one.hessian_matrix(b)))


def test_optimizers_agree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ np.array([1, -2, 0.5, 0, 0])))).astype(float)
    o = Local(losses.LOGISTIC, dense(x), y, np.zeros(300), np.ones(300), 5, Penalty(1.0))
    a, t = optim.lbfgs(o, np.zeros(5), 1e-12), optim.tron(o, np.zeros(5), 1e-12, 100)
    assert np.allclose(a.coefficients, t.coefficients, atol=1e-4) and np.linalg.norm(a.gradient) < 1e-3
    values = [s["value"] for s in a.states]
    assert all(p >= q for p, q in zip(values, values[1:]))
    free = Local(losses.LOGISTIC, dense(x), y, np.zeros(300), np.ones(300), 5)
    sparse = optim.owlqn(free, np.zeros(5), 25.0, 1e-10, 300)
    assert (sparse.coefficients == 0).any() and np.abs(sparse.gradient).max() < 1e-2
    box = optim.lbfgs(o, np.zeros(5), 1e-12, bounds={1: (-0.5, 0.5)})
    assert box.coefficients[1] == -0.5 and np.abs(np.delete(o.value_gradient(box.coefficients)[1], 1)).max() < 1e-3


def test_prior_replaces_l2():
    p = Penalty(0.5, 0, (np.array([1.0, 2.0]), np.array([0.25, 0.0])))
    v, g = p.value_gradient(np.zeros(2))
    assert np.allclose(g, [-4.0, -1.0]) and math.isclose(v, 0.5 * (4 * 1 + 0.5 * 4))


def test_active_passive(spark):
    rows = [(i, "a" if i < 6 else "b" if i < 8 else "c", 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "uid long, ent string, weight double")
    got = dataset.active_passive(df, "ent", cap=4, bound=2).collect()
    by = lambda e, a: [r for r in got if r["ent"] == e and r["active"] == a]
    assert len(by("a", True)) == 4 and len(by("a", False)) == 2 and len(by("b", True)) == 2 and not by("c", True)
    assert {r["weight"] for r in by("a", True)} == {1.5} and {r["weight"] for r in by("a", False)} == {1.0}
    known = spark.createDataFrame([("a",)], "ent string")
    assert {r["ent"] for r in dataset.active_passive(df, "ent", bound=10, existing=known).collect()} == {"b", "c"}


def test_pearson_and_selection(points):
    got = {(r["ent"], r["idx"]): r["correlation"] for r in dataset.feature_scores(points, "ent").collect()}
    for e in (0, 1):
        y, x = np.array([p[0] for p in POINTS[e::2]]), np.array([p[1] for p in POINTS[e::2]])
        assert math.isclose(got[f"e{e}", 0], np.corrcoef(x, y)[0, 1], abs_tol=1e-9) and got[f"e{e}", 2] == 1.0
    assert dataset.select_features(dataset.feature_scores(points, "ent"), "ent", 0.4).count() == 4


def test_metrics(spark):
    rows = [("n", s, y) for s, y in zip((-1, -0.1, 0, 1, 2, 6, 8), (1, 0, 0, 0, 1, 1, 1))] + [("t", s, y) for s, y in zip((-1, -1, -0.1, 0, 2, 6, 8), (1, 0, 0, 0, 1, 1, 1))]
    rows += [("p", 0.5, 1), ("p", 0.5, 1), ("q", 0.5, 0)]
    df = spark.createDataFrame([(i, g, float(s), float(y), 1.0) for i, (g, s, y) in enumerate(rows)], "uid long, g string, score double, label double, weight double")
    by = {r["g"]: r["auc"] for r in evaluate.grouped_auc(df, "g").collect()}
    assert math.isclose(by["n"], 0.75) and math.isclose(by["t"], 0.7916666667, rel_tol=1e-9) and by["p"] is None and by["q"] is None
    assert math.isclose(evaluate.auc(df.where("g = 't'")).first()[0], 0.7916666667, rel_tol=1e-9)
    got = evaluate.evaluate(df, ["AUC:g", "RMSE", "PRECISION@2:g", "AUPR"])
    assert math.isclose(got["AUC:g"], (0.75 + 0.7916666667) / 2, rel_tol=1e-8)
    assert evaluate.evaluate(df.where("g in ('p', 'q')"), ["AUC:g"])["AUC:g"] == 0.0
    n = spark.createDataFrame([(float(i),) for i in range(12)], "y double").select(evaluate.lgamma_plus_one(F.col("y")).alias("v")).collect()
    assert np.allclose([r["v"] for r in n], [math.lgamma(i + 1) for i in range(12)], atol=1e-10)


def mixed_data(spark, n=600):
    rng = np.random.default_rng(5)
    ents = rng.integers(0, 12, n)
    x = rng.normal(size=(n, 2))
    effect = rng.normal(size=12)
    y = x @ [1.0, -0.5] + effect[ents] + 0.1 * rng.normal(size=n)
    rows = [(i, float(y[i]), 0.0, 1.0, [(0, float(x[i, 0])), (1, float(x[i, 1])), (2, 1.0)], [(0, 1.0)], f"e{ents[i]}") for i in range(n)]
    return spark.createDataFrame(rows, f"uid long, label double, offset double, weight double, features {VECTOR}, bias {VECTOR}, ent string").cache(), y, ents, effect


def test_per_entity_ridge(spark):
    df, y, ents, _ = mixed_data(spark)
    c = mixed.RandomCoordinate(Coordinate("r", "bias", "ent", regularization="L2", weight=2.0, tolerance=1e-12), "LINEAR_REGRESSION")
    m = c.train(c.rows(df), F.col("offset"))
    got = {r["ent"]: r["coefficients"][0]["mean"] for r in m.table.collect()}
    for e in range(12):
        assert math.isclose(got[f"e{e}"], y[ents == e].sum() / ((ents == e).sum() + 2.0), rel_tol=1e-6)
    assert c.trackers.agg(F.sum("entities")).first()[0] == 12 and m.summary().first()["entities"] == 12
    later = c.train(c.rows(df.where("ent = 'e1'")), F.col("offset"), m)
    assert later.table.count() == 12  # entities without rows keep their model
    unknown = m.scored(df.limit(1).withColumn("ent", F.lit("zz")), "s").first()["s"]
    assert unknown == 0.0


def test_descent_estimator(spark):
    df, *_ = mixed_data(spark)
    train, test = df.where("uid % 4 <> 0"), df.where("uid % 4 = 0")
    coords = [Coordinate("global", regularization="L2", weights=(10.0, 0.1)), Coordinate("per-ent", "bias", "ent", regularization="L2", weights=(0.1,))]
    est = mixed.Estimator("LINEAR_REGRESSION", coords, passes=2, evaluators=["RMSE"])
    results = est.fit(train, test)
    assert len(results) == 2 and len(grid(coords)) == 2
    combo, best = est.best(results)
    assert combo["global"].weight == 0.1 and best.metrics["RMSE"] < 0.2 and len(best.history) == 4
    assert math.isclose(mixed.Transformer(best.model, ["RMSE"]).evaluate(test)["RMSE"], best.metrics["RMSE"], rel_tol=1e-9)
    locked = mixed.Estimator("LINEAR_REGRESSION", coords, initial=best.model, locked=("global",)).fit(train, test)[0][1]
    assert np.array_equal(locked.model.models["global"].means, best.model.models["global"].means)


def test_incremental(spark):
    df, *_ = mixed_data(spark)
    c = [Coordinate("global", regularization="L2", weights=(0.1,))]
    first = mixed.Estimator("LINEAR_REGRESSION", c, variance="SIMPLE").fit(df)[0][1].model
    again = mixed.Estimator("LINEAR_REGRESSION", c, variance="SIMPLE", initial=first, incremental=True).fit(df.limit(5))[0][1].model
    assert np.allclose(first.models["global"].means, again.models["global"].means, atol=0.1)
    with pytest.raises(ValueError):
        mixed.Estimator("LINEAR_REGRESSION", c, incremental=True)


def test_validation_and_sampling(points, spark):
    dataset.validate(points, "LOGISTIC_REGRESSION")
    bad = points.withColumn("weight", F.when(F.col("uid") == 3, 0.0).otherwise(F.col("weight"))).withColumn("label", F.when(F.col("uid") == 4, 2.0).otherwise(F.col("label")))
    with pytest.raises(ValueError, match="label_invalid.*weight_invalid"):
        dataset.validate(bad, "LOGISTIC_REGRESSION")
    big = spark.range(4000).selectExpr("id as uid", "cast(id % 2 as double) as label", "1.0D as weight")
    got = dataset.down_sample(big, 0.25, "LOGISTIC_REGRESSION", key=F.col("uid")).groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()
    by = {r["label"]: r for r in got}
    assert by[1.0]["n"] == 2000 and by[1.0]["w"] == 1.0 and 400 < by[0.0]["n"] < 600 and by[0.0]["w"] == 4.0
    with pytest.raises(ValueError):
        dataset.down_sample(big, 1.0, "LINEAR_REGRESSION")


def test_configuration_language():
    text = "name=per-song,random.effect.type=songId,feature.shard=s2,active.data.lower.bound=2,active.data.upper.bound=9,optimizer=TRON,max.iter=10,regularization=L2,reg.weights=1|10,down.sampling.rate=0.5"
    c = Coordinate.parse(text)
    assert c.entity == "songId" and c.weights == (1.0, 10.0) and Coordinate.parse(str(c)) == c and [x.weight for x in c.expanded()] == [10.0, 1.0]
    assert str(Shard.parse("name=a,feature.bags=x|y,intercept=false")) == "name=a,feature.bags=x|y,intercept=false"
    for bad in ("name=a,optimizer=TRON,regularization=L1", "name=a,reg.weights=-1", "name=a,active.data.lower.bound=5,active.data.upper.bound=2", "name=a,what=1", "optimizer=TRON"):
        with pytest.raises((ValueError, KeyError)):
            Coordinate.parse(bad)
