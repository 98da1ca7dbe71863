import math

import numpy as np
import pytest

from kestrix.functions.features import NAMED, VECTOR
from kestrix.operators import indexing, mixed
from kestrix.operators.config import Coordinate, Shard
from kestrix.plans import drivers
from kestrix.sources import readers
from kestrix.streaming import scoring


@pytest.fixture(scope="module")
def songs(spark):
    rng = np.random.default_rng(0)
    users = rng.normal(size=8)
    rows = []
    for i in range(400):
        u, x = int(rng.integers(0, 8)), float(rng.normal())
        rows.append((i, float(2 * x + users[u] + 0.1 * rng.normal()), [("x", "", x), ("c", str(u % 2), 1.0)], f"u{u}", None if i % 2 else 1.0))
    return spark.createDataFrame(rows, f"uid long, response double, features {NAMED}, user string, weight double").cache()


def test_train_and_score(spark, songs, tmp_path):
    shards = [Shard("all", ("features",)), Shard("none", ("features",))]
    said = []
    coords = [Coordinate.parse("name=global,feature.shard=all,regularization=L2,reg.weights=0.1|10"), Coordinate.parse("name=per-user,feature.shard=none,random.effect.type=user,regularization=L2,reg.weights=1")]
    out = str(tmp_path / "out")
    combo, best = drivers.train(spark, songs.where("uid % 5 <> 0"), out, "LINEAR_REGRESSION", shards, coords, songs.where("uid % 5 = 0"), 2, ["RMSE"], "STANDARDIZATION", validate="FULL", tuning_mode="RANDOM", tuning_rounds=1, events=drivers.Events([lambda e, d: said.append(e), lambda e, d: 1 / 0]))
    assert best.metrics["RMSE"] < 0.2 and said[0] == "setup" and said[-1] == "finish" and said.count("optimization") == 2
    drivers.build_indexes(spark, songs, shards, str(tmp_path / "idx"))
    indexes = drivers.load_indexes(spark, str(tmp_path / "idx"), shards)
    got = drivers.score(spark, songs.where("uid % 5 = 0"), f"{out}/best", str(tmp_path / "scores"), shards, indexes, ["RMSE"])
    assert math.isclose(got["RMSE"], best.metrics["RMSE"], rel_tol=1e-2)
    r = readers.read_scores(spark, str(tmp_path / "scores"))
    assert r.count() == 80 and r.first()["metadataMap"]["user"].startswith("u")
    with pytest.raises(FileExistsError):
        drivers.train(spark, songs, out, "LINEAR_REGRESSION", shards, coords)


def test_vocabularies(spark, songs, tmp_path):
    drivers.build_vocabularies(songs, ["features"], str(tmp_path / "v"))
    idx = drivers.vocabulary_indexes(spark, str(tmp_path / "v"), [Shard("s", ("features",))])["s"]
    assert idx.count() == 4


def test_single_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x @ [2.0, -1.0] + rng.logistic(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), 0.0, 1.0, [(0, float(x[i, 0])), (1, float(x[i, 1])), (2, 1.0)]) for i in range(300)], f"uid long, label double, offset double, weight double, features {VECTOR}")
    idx = indexing.identity_index(2, spark, True)
    w, m, metrics = drivers.train_single(spark, df.where("uid < 200"), str(tmp_path / "o"), "LOGISTIC_REGRESSION", [100.0, 1.0], 3, idx, df.where("uid >= 200"), intercept=2)
    assert metrics["auc"] > 0.8 and 0 < metrics["peak_f1"] <= 1 and metrics["log_likelihood"] < 0
    lines = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "o" / "best-model-text")).collect()]
    assert len(lines) == 3 and float(lines[0][3]) == w
    with pytest.raises(ValueError):
        drivers.train_single(spark, df, "", "LOGISTIC_REGRESSION", [1.0], 3, idx, normalization="STANDARDIZATION")


def test_days(spark, tmp_path, songs):
    songs.limit(3).write.parquet(str(tmp_path / "2020/01/02"))
    assert drivers.read_input(spark, str(tmp_path), days="20200101-20200103").count() == 3
    with pytest.raises(FileNotFoundError):
        drivers.read_input(spark, str(tmp_path), days="20210101-20210102")
    assert drivers.dataset_summary(songs, "user").first()["rows"] == 400


def test_command_line():
    a = drivers.parser().parse_args(["train", "--input", "i", "--output", "o", "--task", "T", "--shard", "name=s,feature.bags=a|b", "--coordinate", "name=c,feature.shard=s"])
    assert a.shard[0].bags == ("a", "b") and a.coordinate[0].name == "c"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, [(0, float(i))], f"e{i % 2}") for i in range(6)], f"uid long, features {VECTOR}, ent string")
    df.write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("e1", [(0, 1.0, None)])], f"ent string, coefficients {mixed.COEFFICIENTS}")
    model = mixed.MixedModel("LINEAR_REGRESSION", {"g": mixed.FixedModel("features", np.array([2.0])), "r": mixed.RandomModel("features", "ent", table)})
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scoring.write_scores(stream, model, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert {r["uid"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: i * (3.0 if i % 2 else 2.0) for i in range(6)}
