import json

import numpy as np
import pytest

from kestrix.functions.features import NAMED, SEPARATOR
from kestrix.operators.params import flag, list_of
from kestrix.plans import single
from kestrix.plans.single import SingleJob, SingleParameters, Stage
from kestrix.sources.avro import AvroSource

HEARD = []


def hear(event, details):
    HEARD.append((event, details))


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """A folder of records with two features, and the numbers they hold."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + 0.25 + 0.01 * rng.normal(size=200)
    at = str(tmp_path_factory.mktemp("single") / "in")
    rows = [(str(i), float(y[i]), [("a", "", float(x[i, 0])), ("b", "1", float(x[i, 1]))], 0.0, 1.0) for i in range(200)]
    spark.dataSource.register(AvroSource)
    spark.createDataFrame(rows, f"uid string, response double, features {NAMED}, offset double, weight double").write.format(AvroSource.name()).mode("append").save(at)
    return at, x, y


def _args(at, out, **more):
    base = {"training-data-directory": at, "output-directory": str(out), "task": "linear_regression", "convergence-tolerance": "1e-9"}
    return [a for k, v in (base | {k.replace("_", "-"): v for k, v in more.items()}).items() for a in (f"--{k}", v)]


def _ridge(x, y, weight):
    d = np.c_[x, np.ones(len(x))]
    return np.linalg.solve(d.T @ d + np.diag([weight, weight, 0.0]), d.T @ y)


def test_parameters():
    p = SingleParameters()
    assert p.value("regularization-weights") == [10.0] and p.value("summarization-output-dir") is None and len(p.params) == 30
    p.put(task="Poisson_regression", intercept="no", regularization_weights="1,2,1")
    assert p.value("task") == "POISSON_REGRESSION" and p.value("intercept") is False and p.value("regularization-weights") == [1.0, 2.0]
    with pytest.raises(ValueError, match="output-directory"):
        p.check()
    q = p.copy()
    p.reset()
    assert p.value("task") is None and p.value("intercept") is True and q.value("intercept") is False
    for name, bad in (("task", "X"), ("intercept", "maybe"), ("tree-aggregate-depth", "0"), ("elastic-net-alpha", "2"), ("coefficient-box-constraints", "{}"), ("regularization-weights", "-1")):
        with pytest.raises(ValueError):
            p.put(**{name: bad})
    assert flag("YES") and list_of(int)("3,1,3") == [3, 1]
    with pytest.raises(ValueError):
        p.required("task")


@pytest.mark.parametrize("bad", [
    {"regularization-type": "L1", "optimizer": "TRON"},
    {"coefficient-box-constraints": "[]", "normalization-type": "SCALE_WITH_MAX_MAGNITUDE"},
    {"normalization-type": "STANDARDIZATION", "intercept": "false"},
])
def test_excluded_values(bad):
    with pytest.raises(ValueError, match="exclude|needs"):
        SingleParameters().parse(_args("in", "out", **bad), "x")


def test_stages_and_results(spark, records, tmp_path):
    at, x, y = records
    HEARD.clear()
    out = tmp_path / "o"
    job = single.main(_args(at, out, validating_data_directory=at, regularization_weights="100,1", summarization_output_dir=str(tmp_path / "s"), validate_per_iteration="true",
                            event_listeners=f"{__name__}.hear", min_partitions="3", normalization_type="STANDARDIZATION"))
    assert job.stage == Stage.VALIDATED and [e for e, _ in HEARD] == ["setup", "start", "optimization", "optimization", "finish"]
    assert job.best[0] == 1.0 and job.metrics[1.0]["rmse"] < job.metrics[100.0]["rmse"]
    for w, m, r in job.path:
        steps = job.iterations[w]
        assert len(steps) == len(r.path) > 1 and steps[-1]["rmse"] == pytest.approx(job.metrics[w]["rmse"])
    lines = [r["value"].split("\t") for r in spark.read.text(str(out / "learned-models-text")).collect()]
    assert len(lines) == 6 and spark.read.text(str(out / "best-model-text")).count() == 3
    assert {r["featureName"] for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"a", "b"}
    with pytest.raises(RuntimeError):
        job.train()
    with pytest.raises(FileExistsError):
        single.main(_args(at, out))


def test_without_validation(spark, records, tmp_path):
    at, x, y = records
    index = tmp_path / "index"
    first = single.main(_args(at, tmp_path / "o", regularization_weights="5", use_warm_start="false"))
    assert first.stage == Stage.TRAINED and first.best is None
    order = {r["key"]: r["idx"] for r in first.index.collect()}
    got = first.path[0][1].means
    assert np.allclose([got[order[f"a{SEPARATOR}"]], got[order[f"b{SEPARATOR}1"]], got[first.intercept]], _ridge(x, y, 5.0), atol=1e-4)
    first.index.write.parquet(str(index))
    (tmp_path / "names").write_text("a\t\n")
    again = single.main(_args(at, tmp_path / "o", delete_output_dirs_if_exist="true", offheap_indexmap_dir=str(index), selected_features_file=str(tmp_path / "names"), regularization_type="none"))
    assert len(again.path) == 1 and again.path[0][1].means[order[f"b{SEPARATOR}1"]] == 0
    with pytest.raises(FileNotFoundError):
        single.main(_args(at, tmp_path / "p", selected_features_file=str(tmp_path / "none")))


def test_bounds_elastic_net_libsvm(spark, records, tmp_path):
    at, _, _ = records
    bounds = json.dumps([{"name": "a", "term": "*", "upperBound": 1.0}])
    job = single.main(_args(at, tmp_path / "b", coefficient_box_constraints=bounds, regularization_type="NONE"))
    a = {r["key"]: r["idx"] for r in job.index.collect()}[f"a{SEPARATOR}"]
    assert job.path[0][1].means[a] == pytest.approx(1.0)
    job = single.main(_args(at, tmp_path / "e", regularization_type="elastic_net", regularization_weights="100000"))
    assert np.allclose(job.path[0][1].means, 0)
    (tmp_path / "x.txt").write_text("+1 1:2 2:1\n-1 1:-1\n+1 2:3\n-1 1:-2 2:-1\n")
    args = _args(str(tmp_path / "x.txt"), tmp_path / "l", task="LOGISTIC_REGRESSION", input_file_format="libsvm", intercept="false")
    with pytest.raises(ValueError):
        single.main(args)
    job = single.main([*args, "--feature-dimension", "2", "--delete-output-dirs-if-exist", "true"])
    assert job.size == 2 and job.intercept is None and (job.path[0][1].means > 0).all()


def test_bad_listener(spark, tmp_path):
    p = SingleParameters().put(training_data_directory="i", output_directory="o", task="LINEAR_REGRESSION", event_listeners="no.such.Thing")
    with pytest.raises(ValueError, match="listener"):
        SingleJob(spark, p)
