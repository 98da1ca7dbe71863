import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrix.functions.features import NAMED, VECTOR, DateRange, key, name_of, term_of
from kestrix.operators import indexing, mixed, tuning
from kestrix.operators.config import Coordinate, Shard
from kestrix.sources import avro, readers, writers


def test_sobol_and_discretize():
    p = tuning.sobol(256, 5)
    assert p.shape == (256, 5) and (np.abs(p.mean(axis=0) - 0.5) < 0.01).all()
    for d in range(5):
        assert len(set(np.floor(p[:, d] * 256))) == 256  # each in its own stratum
    assert tuning.discretize(np.array([0.55, 0.55]), {1: 4}).tolist() == [0.55, 0.5]


def test_kernels():
    x = np.array([[0.0], [1.0]])
    assert math.isclose(tuning.Kernel(kind="rbf")(x, x)[0, 1], math.exp(-0.5))
    r = math.sqrt(5)
    assert math.isclose(tuning.Kernel()(x, x)[0, 1], (1 + r + 5 / 3) * math.exp(-r))
    assert tuning.Kernel(scales=(3.0,)).log_likelihood(x, np.zeros(2)) == -math.inf


def test_acquisition():
    ei = tuning.expected_improvement(0.0)(np.array([0.0, 5.0]), np.array([1.0, 1.0]))
    assert math.isclose(ei[0], 1 / math.sqrt(2 * math.pi)) and ei[1] < 1e-5
    assert tuning.confidence_bound()(np.array([1.0]), np.array([4.0]))[0] == -3.0


def test_search_finds_minimum():
    f = lambda x: (float((x[0] - 0.3) ** 2 + (x[1] - 0.7) ** 2), None)
    got = tuning.search(14, 2, "BAYESIAN", f, seed=1)
    assert min(v for _, v, _ in got) < 0.02 and len(tuning.search(3, 2, "RANDOM", f)) == 3 and tuning.search(3, 2, "NONE", f) == []
    assert tuning.tuner("DUMMY")(3, 2, "RANDOM", f) == []


def test_slice_sampler():
    rng, x, out = np.random.default_rng(2), np.zeros(2), []
    for _ in range(3000):
        x = tuning.slice_sample(lambda t: -0.5 * float(((t - 1) ** 2).sum()), x, rng)
        out.append(x)
    assert np.allclose(np.mean(out, axis=0), 1, atol=0.15) and np.allclose(np.var(out, axis=0), 1, atol=0.25)


def test_rescaling_and_shrinking():
    c = tuning.SearchConfig.from_json('{"tuning_mode": "BAYESIAN", "variables": {"a": {"type": "FLOAT", "min": 1e-3, "max": 1e3, "transform": "LOG"}, "b": {"type": "FLOAT", "min": 0, "max": 2}}}')
    v = c.variables[0]
    assert math.isclose(v.scale(1.0), 0.5) and math.isclose(v.unscale(v.scale(7.0)), 7.0)
    pts = tuning.sobol(12, 2)
    got = tuning.shrink(c, [(p, -((p[0] - 0.5) ** 2)) for p in pts], 0.2, 100)
    assert c.variables[0].low <= got["a"][0] < 1 < got["a"][1] <= c.variables[0].high
    assert c.priors('{"records": [{"a": 1.0, "evaluationValue": 3}]}', {"b": 1.0})[0][0].tolist() == [0.5, 0.5]


def test_dates():
    d = DateRange.parse("20200228-20200301")
    assert [str(x) for x in d.days()] == ["2020-02-28", "2020-02-29", "2020-03-01"] and d.paths("b")[0] == "b/2020/02/28"
    assert DateRange.days_ago("3-1", dt.date(2020, 1, 4)).start == dt.date(2020, 1, 1)
    with pytest.raises(ValueError):
        DateRange.parse("20200302-20200301")


@pytest.fixture(scope="module")
def bags(spark):
    rows = [(0, 1.0, [("a", "x", 2.0), ("b", "", 1.0)], [("c", "1", 5.0)]), (1, 0.0, [("a", "x", 3.0)], []), (2, 1.0, None, [("d", None, 1.0)])]
    return spark.createDataFrame(rows, f"uid long, label double, f1 {NAMED}, f2 {NAMED}")


def test_index_and_shards(spark, bags):
    out, idx = readers.read_merged(bags, [Shard("s", ("f1", "f2")), Shard("t", ("f1",), False)])
    names = {(r["n"], r["t"]): r["idx"] for r in idx["s"].select(name_of(F.col("key")).alias("n"), term_of(F.col("key")).alias("t"), "idx").collect()}
    assert names == {("a", "x"): 0, ("b", ""): 1, ("c", "1"): 2, ("d", ""): 3, ("(INTERCEPT)", ""): 4}
    rows = {r["uid"]: [tuple(x) for x in r["s"]] for r in out.collect()}
    assert rows == {0: [(0, 2.0), (1, 1.0), (2, 5.0), (4, 1.0)], 1: [(0, 3.0), (4, 1.0)], 2: [(3, 1.0), (4, 1.0)]}
    twice = bags.withColumn("f2", F.col("f1"))
    assert indexing.duplicates(twice, ["f1", "f2"]).count() == 3
    with pytest.raises(Exception, match="duplicate"):
        readers.read_merged(twice, [Shard("s", ("f1", "f2"))])[0].collect()


def test_model_round_trip(spark, tmp_path, bags):
    idx = {"s": readers.read_merged(bags, [Shard("s", ("f1", "f2"))])[1]["s"]}
    table = spark.createDataFrame([("u1", [(0, 1.0, 0.5), (4, -2.0, None)]), ("u2", [(1, 1e-9, None)])], f"user string, coefficients {mixed.COEFFICIENTS}")
    m = mixed.MixedModel("LINEAR_REGRESSION", {"g": mixed.FixedModel("s", np.array([1.0, 0, -3, 1e-6, 2]), np.ones(5)), "r": mixed.RandomModel("s", "user", table)})
    writers.save_model(spark, m, f"{tmp_path}/m", idx, {"g": Coordinate("g"), "r": Coordinate("r", entity="user")})
    got = writers.load_model(spark, f"{tmp_path}/m", idx)
    assert got.task == m.task and got.models["g"].means.tolist() == [1.0, 0, -3.0, 0, 2.0]  # the small one is gone
    assert {r["user"]: [(c["idx"], c["mean"]) for c in r["coefficients"]] for r in got.models["r"].table.collect()} == {"u1": [(0, 1.0), (4, -2.0)]}
    assert list(writers.load_model(spark, f"{tmp_path}/m", idx, ["r"]).models) == ["r"]
    saved = spark.read.parquet(f"{tmp_path}/m/fixed-effect/g/coefficients")
    assert writers.has_intercept(saved) and [f["value"] for f in saved.first()["means"]] == [-3.0, 2.0, 1.0] and writers.model_index(saved).count() == 3
    with pytest.raises(FileExistsError):
        writers.save_model(spark, m, f"{tmp_path}/m", idx)


def test_avro_round_trip(spark, tmp_path):
    feature = {"type": "record", "name": "FeatureX", "fields": [{"name": "name", "type": "string"}, {"name": "term", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}
    schema = {"type": "record", "name": "Row", "fields": [
        {"name": "uid", "type": ["null", "string"]}, {"name": "label", "type": ["int", "double"]}, {"name": "features", "type": {"type": "array", "items": feature}},
        {"name": "metadataMap", "type": ["null", {"type": "map", "values": "string"}]}, {"name": "n", "type": "long"}]}
    rows = [{"uid": f"é{i}" if i % 2 else None, "label": i, "features": [{"name": "a", "term": None, "value": i / 3}] * (i % 3), "metadataMap": {"k": "v"} if i else None, "n": -(10**12) * i} for i in range(9)]
    for codec in ("null", "deflate"):
        avro.write_file(f"{tmp_path}/{codec}.avro", schema, rows, codec, block=4)
    spark.dataSource.register(avro.AvroSource)
    df = spark.read.format("kestrix-avro").load(str(tmp_path))
    got = df.where("n = -8000000000000").collect()
    assert len(got) == 2 and got[0]["label"] == 8.0 and got[0]["features"][1]["value"] == 8 / 3 and got[0]["metadataMap"] == {"k": "v"} and df.count() == 18


def test_libsvm_and_scores(spark, tmp_path):
    (tmp_path / "x.txt").write_text("+1 1:0.5 3:2\n-1 2:1\n\n")
    rows = [(r["label"], [tuple(x) for x in r["features"]]) for r in readers.read_libsvm(spark, str(tmp_path / "x.txt"), 3).orderBy("uid").collect()]
    assert rows == [(1.0, [(0, 0.5), (2, 2.0), (3, 1.0)]), (0.0, [(1, 1.0), (3, 1.0)])]
    scored = spark.createDataFrame([(1, 0.5, 1.0, 2.0, "q")], "uid long, score double, label double, weight double, tag string")
    writers.write_scores(scored, str(tmp_path / "s"), tags=("tag",))
    r = readers.read_scores(spark, str(tmp_path / "s")).first()
    assert (r["uid"], r["predictionScore"], r["modelId"], r["metadataMap"]) == ("1", 0.5, "N/A", {"tag": "q"})


def test_training_records(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, None, 0.0, [("f", "t", 1.0)]), ("b", 0.0, 2.0, 3.0, [("f", "t", 1.0), ("g", None, 2.0)])], f"uid string, response double, offset double, weight double, features {NAMED}")
    got = readers.read_training_records(df, "RESPONSE_PREDICTION").collect()
    assert [r["uid"] for r in got] == ["b"]
    only = readers.read_training_records(df, "RESPONSE_PREDICTION", spark.createDataFrame([("g", "")], "name string, term string")).first()
    assert [f["name"] for f in only["features"]] == ["g"]
    with pytest.raises(Exception, match="negative weight"):
        readers.read_training_records(df.withColumn("weight", F.lit(-1.0)), "RESPONSE_PREDICTION").collect()
    idx = indexing.index(df.select(F.explode("features").alias("f")).select(key(F.col("f.name"), F.col("f.term")).alias("key")))
    vec = indexing.shard(df, ["features"], idx, name="v")
    writers.write_training(vec, str(tmp_path / "t"), idx, "response", "v")
    assert {r["uid"]: len(r["features"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": 1, "b": 2}
    writers.write_names(readers.indexing.vocabulary(df, ["features"]), str(tmp_path / "n"))
    assert readers.read_names(spark, str(tmp_path / "n")).count() == 2


def test_estimator_function(spark):
    base = {"g": Coordinate("g", regularization="L2"), "h": Coordinate("h", regularization="ELASTIC_NET", alpha=0.5)}
    f = tuning.EstimatorFunction(None, base, None, None, True)
    assert f.dimensions == 3 and math.isclose(f.configuration(np.array([0.5, 0.5, 0.5]))["g"].weight, 1.0)
    x = np.array([0.2, 0.4, 0.9])
    assert np.allclose(f.vector(f.configuration(x)), x)


def test_empty_vector(spark):
    df = spark.createDataFrame([(1, [])], f"uid long, features {VECTOR}")
    assert mixed.MixedModel("LINEAR_REGRESSION", {"g": mixed.FixedModel("features", np.ones(3))}).score(df).first()["score"] == 0.0
