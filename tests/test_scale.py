"""Paths that only large data take, on small tables with their bounds lowered."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrix.functions import losses, optim, optim_many
from kestrix.operators import config, evaluate, indexing, mixed, objective, partitioning
from kestrix.plans import catalog, single
from kestrix.sources import avro

ROW = "uid long, bag array<struct<name:string,term:string,value:double>>"


def test_sums_by_chunk_and_level(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(float(rng.integers(0, 2)), 0.1, 1.0 + i % 3, [(j, float(rng.normal())) for j in range(7)]) for i in range(200)]
    d = spark.createDataFrame(rows, "label double, offset double, weight double, features array<struct<idx:int,val:double>>").repartition(30)
    b = rng.normal(size=7)
    want = objective.Distributed(losses.LOGISTIC, d, 7)
    value, gradient, matrix = *want.value_gradient(b), want.hessian_matrix(b)
    monkeypatch.setattr(objective, "PARTIALS", 3)
    monkeypatch.setattr(objective, "CHUNK", 4)
    monkeypatch.setattr(objective, "DENSE", 20)
    got = objective.Distributed(losses.LOGISTIC, d, 7)
    v, g = got.value_gradient(b)
    assert np.isclose(v, value) and np.allclose(g, gradient) and np.allclose(got.hessian_matrix(b), matrix)


@pytest.mark.parametrize("small", [True, False])
def test_shard_keeps_rows_of_one_uid(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(indexing, "BROADCAST_ROWS", 1)
    rows = [(1, [("a", "x", 1.0), ("b", None, 2.0)]), (1, [("a", "x", 3.0)]), (1, [("a", "x", 3.0)]), (2, []), (3, None), (None, [("zz", "", 1.0), ("b", "", 5.0)])]
    d = spark.createDataFrame(rows, ROW)
    index = indexing.index(indexing.vocabulary(d.where("uid = 1"), ["bag"]).select(F.concat("name", F.lit("\x01"), "term").alias("key")), True)
    got = sorted(((r["uid"] or 0, [tuple(x) for x in r["v"]]) for r in indexing.shard(d, ["bag"], index, "uid", True, "v").collect()))
    assert got == [(0, [(1, 5.0), (2, 1.0)]), (1, [(0, 1.0), (1, 2.0), (2, 1.0)]), (1, [(0, 3.0), (2, 1.0)]), (1, [(0, 3.0), (2, 1.0)]), (2, [(2, 1.0)]), (3, [(2, 1.0)])]
    twice = spark.createDataFrame([(1, [("a", "x", 1.0), ("a", "x", 2.0)])], ROW)
    with pytest.raises(Exception, match="duplicate features"):
        indexing.shard(twice, ["bag"], index).collect()


def test_index_is_in_key_order(spark, monkeypatch):
    monkeypatch.setattr(indexing, "PARTS", 7)
    monkeypatch.setattr(indexing, "DRAWN", 50)
    names = [f"same-prefix-{i * 37 % 500}" for i in range(500)]
    got = indexing.index(spark.createDataFrame([(n,) for n in names], "key string")).collect()
    assert {r["key"]: r["idx"] for r in got} == {k: i for i, k in enumerate(sorted(set(names)))}
    assert indexing.index(spark.createDataFrame([], "key string")).count() == 0


def test_curve_with_outliers(spark):
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.normal(size=300).round(2), [1e300, -1e300, float("inf")]])
    y = rng.integers(0, 2, len(s)).astype(float)
    d = spark.createDataFrame(list(zip(map(float, s), map(float, y))), "score double, label double")
    p, q = s[y == 1], s[y == 0]
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert np.isclose(evaluate.auc(d).first()[0], want)


def test_hot_and_null_entities(spark, monkeypatch):
    monkeypatch.setattr(mixed, "HOT_ROWS", 20)
    rows = [(i, float(i % 5), 0.0, 1.0, "hot" if i < 40 else None if i < 50 else f"e{i % 3}", [(0, 1.0)]) for i in range(80)]
    d = spark.createDataFrame(rows, "uid long, label double, offset double, weight double, e string, features array<struct<idx:int,val:double>>")
    c = mixed.RandomCoordinate(config.Coordinate("r", entity="e", tolerance=1e-12), "LINEAR_REGRESSION")
    got = {r["e"]: r["coefficients"][0]["mean"] for r in c.train(c.rows(d), F.col("offset")).table.collect()}
    for e in ("hot", None, "e0", "e1", "e2"):
        mine = [y for _, y, _, _, k, _ in rows if k == e]
        assert np.isclose(got[e], np.mean(mine))


def test_bins(spark):
    d = spark.createDataFrame([(f"e{i}",) for i in range(20) for _ in range(1 + i * i)], "e string").union(spark.createDataFrame([(None,)] * 5, "e string"))
    bins = partitioning.entity_bins(d, "e", 4, None, 10)
    loads = [sum(1 + int(e[1:]) ** 2 for e, b in bins.items() if b == k) for k in range(4)]
    assert len(bins) == 10 and max(loads) - min(loads) <= 362 and bins["e19"] == 0 and bins["e18"] == 1
    assert partitioning.by_entity(d, "e", 4).count() == d.count()
    parts = partitioning.by_entity(d, "e", 4).withColumn("p", F.spark_partition_id()).groupBy("e").agg(F.count_distinct("p").alias("n"))
    assert parts.where("n > 1").count() == 0


@pytest.mark.parametrize("n, cap", [(4, None), (7, 30), (3, 1)])
def test_every_entity_has_an_even_bin(spark, monkeypatch, n, cap):
    monkeypatch.setattr(indexing, "PARTS", 5)
    monkeypatch.setattr(partitioning, "CAPACITY", 3)
    counts = {f"e{i}": 1 + i * i % 41 for i in range(60)} | {None: 9}
    d = spark.createDataFrame([(e,) for e, k in counts.items() for _ in range(k)], "e string")
    got = {r["e"]: r["bin"] for r in partitioning.even_bins(d, "e", n, cap).collect()}
    load = {e: k if cap is None else min(k, cap) for e, k in counts.items()}
    bins, want = [0] * n, {}
    for e in sorted(load, key=lambda e: (-load[e], e is not None, e or "")):
        want[e] = bins.index(min(bins))
        bins[want[e]] += load[e]
    assert got == want and max(bins) - min(bins) <= max(load.values())
    of = {r["e"]: r["bin"] for r in partitioning.with_bin(d, "e", n, partitioning.even_bins(d, "e", n, cap)).distinct().collect()}
    assert of == want and partitioning.by_entity(d, "e", n, cap).count() == d.count()


def test_entity_bins_query_beyond_capacity(spark, monkeypatch):
    monkeypatch.setattr(partitioning.entity_bins, "__defaults__", (None, 2))
    row = catalog.QUERIES["entity_bins"](spark, "/root/testdata/sf0.01").first()
    assert row["even"]


def test_box_constraint_errors():
    index = [("a\x01x", 0), ("a\x01y", 1), ("(INTERCEPT)\x01", 2)]
    read = lambda *e: config.box_constraints(__import__("json").dumps(e), index, 2)
    assert read({"name": "*", "term": "*", "upperBound": 1}) == {0: (float("-inf"), 1.0), 1: (float("-inf"), 1.0)}
    for bad in (
        [{"name": "a"}], [{"name": "a", "term": "x"}], [{"name": "a", "term": "x", "lowerBound": 2, "upperBound": 1}], [{"name": "*", "term": "x", "lowerBound": 0}],
        [{"name": "*", "term": "*", "lowerBound": 0}, {"name": "a", "term": "x", "lowerBound": 0}], [{"name": "a", "term": "*", "lowerBound": 0}, {"name": "a", "term": "x", "lowerBound": 0}],
    ):
        with pytest.raises(ValueError):
            read(*bad)


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_splits(tmp_path, codec):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "s", "type": ["null", "string"]}]}
    rows = [{"a": i, "s": None if i % 5 == 0 else "v" * (i % 90)} for i in range(1000)]
    at = f"{tmp_path}/x.avro"
    avro.write_file(at, schema, rows, codec, block=7)
    size = avro.files(at)[0][1]
    for split in (1, 13, 100, 777, size):
        step = max(split, size // 200)
        found = [r for k in range(0, size, step) for r in avro.read_file(f"file://{at}", k, min(k + step, size))]
        assert found == [(r["a"], r["s"]) for r in rows]


KINDS = ["int", "long", "float", "double", "string", "boolean", "bytes"]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_blocks_become_columns(tmp_path, codec):
    fields = [{"name": k, "type": ["null", k] if i % 2 else k} for i, k in enumerate(KINDS)]
    item = {"type": "record", "name": "I", "fields": [{"name": "n", "type": ["string", "null"]}, {"name": "v", "type": "double"}]}
    fields += [{"name": "bag", "type": ["null", {"type": "array", "items": ["null", item]}]}, {"name": "deep", "type": {"type": "array", "items": {"type": "array", "items": "long"}}}]
    schema = {"type": "record", "name": "R", "fields": fields}
    rows = [{"int": -i, "long": None if i % 3 else i << 40, "float": i / 2, "double": None if i % 7 == 0 else -i / 3, "string": "ä" * (i % 200), "boolean": None if i % 5 else i % 2 == 0, "bytes": bytes([i % 256]) * 3,
             "bag": None if i % 4 == 0 else [None if j == 1 else {"n": None if j == 2 else "x", "v": j / 7} for j in range(i % 5)], "deep": [[j] * j for j in range(i % 4)]} for i in range(300)]
    at = f"{tmp_path}/x.avro"
    wrap = lambda r: r | {"bag": r["bag"] and [x and type("I", (), x) for x in r["bag"]]}
    avro.write_file(at, schema, map(wrap, rows), codec, block=7)
    size = avro.files(at)[0][1]
    batches = [b for k in range(0, size, 777) for b in avro.read_batches(at, k, k + 777)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches) and [r for b in batches for r in b.to_pylist()] == rows
    again = f"{tmp_path}/y.avro"
    avro.write_file(again, schema, avro._encoded(avro.Schema(schema), batches), codec, block=7, encoded=True)
    assert list(avro.read_file(again)) == list(avro.read_file(at))


def test_avro_unions_of_types_are_read_by_record(tmp_path):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "int", "double"]}]}
    at = f"{tmp_path}/x.avro"
    avro.write_file(at, schema, [{"a": 1}, {"a": None}])
    assert list(avro.read_batches(at)) == [(1.0,), (None,)]


def test_path_packs_rows_once_and_the_same_folder_is_read_once(spark, monkeypatch, tmp_path):
    spark.dataSource.register(avro.AvroSource)
    rows = [(str(i), float(i % 4), [("a", "", float(i))], 0.0, 1.0) for i in range(40)]
    kind = "uid string, response double, features array<struct<name:string,term:string,value:double>>, offset double, weight double"
    spark.createDataFrame(rows, kind).write.format("kestrix-avro").mode("append").save(f"{tmp_path}/in")
    made, read = [], []
    pack, one = mixed.packed, single.SingleJob._read
    monkeypatch.setattr(mixed, "packed", lambda d: made.append(1) or pack(d))
    monkeypatch.setattr(single.SingleJob, "_read", lambda self, at: read.append(at) or one(self, at))
    job = single.main(["--training-data-directory", f"{tmp_path}/in", "--validating-data-directory", f"{tmp_path}/in", "--output-directory", f"{tmp_path}/out", "--task", "linear_regression", "--regularization-weights", "10,1"])
    assert len(made) == 1 and len(read) == 1 and set(job.metrics) == {1.0, 10.0}


def _problems(kind, rng):
    """Rows of 60 problems of two coefficients and one of them alone."""
    by = np.repeat(np.arange(60), rng.integers(1, 40, 60))
    n = len(by)
    y = {"LOGISTIC": rng.integers(0, 2, n), "HINGE": rng.integers(0, 2, n), "SQUARED": rng.normal(size=n), "POISSON": rng.poisson(2, n)}[kind].astype(float)
    return by, y, rng.normal(size=n) * 0.3, 1 + rng.random(n), np.c_[rng.random(n), np.ones(n)]


@pytest.mark.parametrize("most", [2, 30])
@pytest.mark.parametrize("kind, name", [("LOGISTIC", "lbfgs"), ("LOGISTIC", "tron"), ("SQUARED", "lbfgs"), ("SQUARED", "tron"), ("POISSON", "lbfgs"), ("POISSON", "tron"), ("HINGE", "lbfgs")])
def test_problems_side_by_side_take_the_steps_of_one(kind, name, most):
    loss = getattr(losses, kind)
    by, y, offset, weight, x = _problems(kind, np.random.default_rng(3))
    n, rows = 60, len(by)
    many = objective.Many(loss, objective.Sparse(rows, np.repeat(np.arange(rows), 2), (by[:, None] * 2 + [0, 1]).ravel(), x.ravel()), y, offset, weight, by, np.repeat(np.arange(n), 2), n, np.tile([0.5, 0.0], n), np.zeros(2 * n))
    got, reasons, iterations = getattr(optim_many, name)(many, np.full(2 * n, 0.1), max_iterations=most)
    for e in range(n):
        k = by == e
        own = objective.Local(loss, objective.Sparse(k.sum(), np.repeat(np.arange(k.sum()), 2), np.tile([0, 1], k.sum()), x[k].ravel()), y[k], offset[k], weight[k], 2, objective.Penalty(0.5, 1))
        want = getattr(optim, name)(own, np.full(2, 0.1), max_iterations=most)
        assert np.allclose(got[2 * e : 2 * e + 2], want.coefficients, atol=1e-6, rtol=1e-6)
        assert (reasons[e], iterations[e]) == (want.reason, want.iterations)


@pytest.mark.parametrize("more", [{}, {"optimizer": "TRON"}, {"bounds": {1: (-0.1, 0.1)}}])
def test_entities_together_and_one_by_one(spark, monkeypatch, more):
    monkeypatch.setattr(mixed, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 2)), 0.1, 1.0, None if i % 11 == 0 else f"e{i % 9}", [(0, float(rng.normal())), (1, 1.0)] if i % 4 else [(1, 1.0)]) for i in range(120)]
    d = spark.createDataFrame(rows, "uid long, label double, offset double, weight double, e string, features array<struct<idx:int,val:double>>")
    old = spark.createDataFrame([("gone", [(3, 1.5, 0.2)]), ("e1", [(0, 0.3, 0.5), (7, 0.2, None)]), (None, [(1, -0.4, 0.1)])], f"e string, coefficients {mixed.COEFFICIENTS}")
    before = mixed.RandomModel("features", "e", old)

    def run(**prior):
        c = mixed.RandomCoordinate(config.Coordinate("r", entity="e", regularization="L2", weight=2.0, tolerance=1e-12, max_iterations=60, **more), "LOGISTIC_REGRESSION", variance="SIMPLE")
        out = c.train(c.rows(d), F.col("offset"), before, before if prior else None)
        return {r["e"]: {x["idx"]: (x["mean"], x["variance"]) for x in r["coefficients"]} for r in out.table.collect()}

    for prior in ({}, {"prior": True}):
        with monkeypatch.context() as m:
            got = run(**prior)
            m.setattr(mixed._Solver, "_plain", lambda self: False)
            want = run(**prior)
        assert set(got) == set(want) == {None, "gone", *(f"e{i}" for i in range(9))} and got["gone"] == {3: (1.5, 0.2)}
        for e in want:
            assert set(got[e]) == set(want[e]) and all(np.allclose(got[e][k], want[e][k], atol=1e-5) for k in want[e])


def test_kept_rows_are_a_table_until_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: f"file://{tmp_path}")
    d = mixed.kept(spark.range(100).selectExpr("id AS uid", "id % 7 AS e"))
    there = list(tmp_path.glob("kestrix-rows-*/*.zstd.parquet"))
    assert there and d.count() == 100 and not d.storageLevel.useMemory
    mixed.dropped(d)
    assert not list(tmp_path.glob("kestrix-rows-*"))
