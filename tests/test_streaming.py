"""A stream of blocks gives what the whole signal gives at once."""

import numpy as np

from ondelys.operators.kdtree import KDTree, KNNClassifier, KNNRegressor
from ondelys.schema import from_rows
from ondelys.signal import decompose, descriptors, slicers
from ondelys.streaming import blocks


def _run(spark, tmp_path, make, x, size, order="frame", resets=()):
    folder, out = tmp_path / "in", f"out_{abs(hash(str(tmp_path)))}"
    schema = "stream_id string, block long, samples array<double>, reset boolean"
    for n, at in enumerate(range(0, len(x), size)):
        spark.createDataFrame([("s", n, [float(v) for v in x[at : at + size]], n in resets)], schema).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(folder))
    running = make(stream if resets else stream.drop("reset")).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(90)
    return spark.table(out).orderBy(order).collect()


def test_running_stats(spark, tmp_path):
    x = np.array([1, 2, np.nan, 4, 5.0, 6])
    rows = _run(spark, tmp_path, lambda s: blocks.running_stats(s, 3), np.nan_to_num(x), 2)
    want = [np.nan_to_num(x)[max(0, i - 2) : i + 1] for i in range(6)]
    assert np.allclose([r["mean"] for r in rows], [w.mean() for w in want])
    assert np.allclose([r["std"] for r in rows], [w.std(ddof=1) if len(w) > 1 else 0 for w in want])


def test_features(spark, tmp_path):
    x = np.sin(np.arange(1000) * 0.1)
    rows = _run(spark, tmp_path, lambda s: blocks.features(s, "spectral_shape", 8000.0, 128, 64), x, 300)
    whole = descriptors.spectral_shape(x, 8000.0, win=128, hop=64, padding="none")
    assert np.allclose([r["features"] for r in rows], whole)


def test_features_with_a_past(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=900) * np.repeat([0.1, 1, 0.2], 300)
    rows = _run(spark, tmp_path, lambda s: blocks.features(s, "onset_feature", 8000.0, 64, 32, metric=2, filter_size=5), x, 170)
    whole = descriptors.onset_feature(x, 8000.0, 2, 5, win=64, hop=32, padding="none")
    assert np.allclose([r["features"] for r in rows], whole[: len(rows)]) and len(rows) == len(whole)


def test_reset_forgets(spark, tmp_path):
    rows = _run(spark, tmp_path, lambda s: blocks.running_stats(s, 3), np.arange(6.0), 2, ["frame", "mean"], resets=(2,))
    assert [(r["frame"], r["mean"]) for r in rows] == [(0, 0.0), (0, 4.0), (1, 0.5), (1, 4.5), (2, 1.0), (3, 2.0)]


def test_slicers(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=1500) * 0.01
    x[[300, 700, 1203]] += 1
    rows = _run(spark, tmp_path / "a", lambda s: blocks.amp_slices(s, 44100.0, 10, 5, 20, 10, 220, 441, 441, -60), x, 400, "onset")
    assert [r["onset"] for r in rows] == slicers.amp_slice(x, 44100.0, 10, 5, 20, 10, 220, 441, 441, -60).tolist() and rows
    rows = _run(spark, tmp_path / "b", lambda s: blocks.onset_slices(s, 44100.0, 2, 0.02, 2, 5, 64, 32), x, 400, "onset")
    value = descriptors.onset_feature(x, 44100.0, 2, 5, win=64, hop=32, padding="none")[:, 0]
    want = slicers._debounced((value > 0.02) & (np.r_[0.0, value[:-1]] < 0.02), 2) * 32 + 32
    assert [r["onset"] for r in rows] == want.tolist() and len(rows) >= 3


def test_parts(spark, tmp_path):
    x = np.sin(np.arange(1600) * 0.3) + np.random.default_rng(2).normal(size=1600) * 0.1
    settings = {"win": 64, "hop": 32, "fft": 64}
    rows = _run(spark, tmp_path / "a", lambda s: blocks.hpss(s, 8000.0, 5, 5, **settings), x, 500, ["part", "start"])
    whole = decompose.hpss(x, 8000.0, 5, 5, **settings)
    for part in ("harmonic", "percussive", "residual"):
        got = np.concatenate([r["samples"] for r in rows if r["part"] == part])
        assert len(got) > 1200 and np.allclose(got, whole[part][: len(got)])
    bases = [[1.0] * 33, [float(i) for i in range(33, 0, -1)]]
    rows = _run(spark, tmp_path / "b", lambda s: blocks.nmf_filter(s, bases, 8000.0, **settings), x, 500, ["part", "start"])
    whole = decompose.nmf_filter(x, 8000.0, bases, **settings)
    got = np.concatenate([r["samples"] for r in rows if r["part"] == "component-1"])
    assert len(got) > 1200 and np.allclose(got, whole["component-1"][: len(got)])
    rows = _run(spark, tmp_path / "c", lambda s: blocks.activations(s, bases, **settings), x, 500)
    assert len(rows) == 1 + (1600 - 64) // 32 and len(rows[0]["features"]) == 2


def test_triggered_models(spark, tmp_path):
    ds = from_rows(spark, [(f"p{i}", [float(i), float(i * i % 7)]) for i in range(30)])
    labels = ds.selectExpr("id", "pos", "IF(pos < 15, 'low', 'high') AS label")
    tree = KDTree.fit(ds)
    classifier, regressor = KNNClassifier.fit(ds, labels, 3), KNNRegressor.fit(ds, ds, 1)
    folder = tmp_path / "in"
    rows = [(i, [i + 0.1, float(i * i % 7)], i % 2) for i in range(10)]
    spark.createDataFrame(rows, "n long, point array<double>, trigger int").write.json(str(folder))
    stream = spark.readStream.schema("n long, point array<double>, trigger int").json(str(folder))
    found = blocks.triggered(stream, lambda p: regressor.predict(classifier.predict(tree.query(p, 2))))
    found.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    got = spark.table("answers").orderBy("n").collect()
    assert [r["n"] for r in got] == [1, 3, 5, 7, 9]
    assert all(r["ids"][0] == f"p{r['n']}" and abs(r["distances"][0] - 0.1) < 1e-9 and r["label"] == "low" and r["target"] == [r["n"], r["n"] ** 2 % 7] for r in got)
