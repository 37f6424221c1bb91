import numpy as np
import pytest
from pyspark.sql import functions as F

from ondelys import schema
from ondelys.schema import DataError, from_rows
from ondelys.operators import buffers, clustering, labels, networks, reduction, scalers, signals, stats, tables
from ondelys.operators.query import DataSetQuery
from ondelys.sources import audio, json_io


@pytest.fixture(scope="module")
def small(spark):
    return schema.from_rows(spark, [("zero", [0, 1, 2, 3, 4]), ("one", [5, 6, 7, 8, 9])])


def test_verbs(spark, small):
    more = tables.add(small, "two", [1, 1, 1, 1, 1])
    assert tables.get(more, "two") == [1.0] * 5 and tables.size(more) == 3
    for bad in (lambda: tables.add(more, "two", [1] * 5), lambda: tables.add(more, "x", [1]), lambda: tables.get(more, "x"), lambda: tables.update(more, "x", [1] * 5), lambda: tables.delete(more, "x"), lambda: tables.add(more, "", [1] * 5)):
        with pytest.raises(schema.DataError):
            bad()
    assert tables.get(tables.update(more, "one", [9] * 6), "one") == [9.0] * 5
    left = tables.delete(more, "zero").orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in left] == [("one", 0), ("two", 1)]
    assert tables.size(tables.clear(more)) == 0
    assert "rows: 3 cols: 5" in tables.show(more)
    assert [r["id"] for r in tables.id_sequence(spark, 4, "p", 1, 3).orderBy("pos").collect()] == ["p1", "p2", "p3", "p1"]


def test_query_rules(small):
    q = DataSetQuery().add_column(4).add_column(1).add_column(4)
    assert [r["point"] for r in q.transform(small).orderBy("pos").collect()] == [[1.0, 4.0], [6.0, 9.0]]
    for bad in (lambda: DataSetQuery().transform(small), lambda: q.filter(9, ">", 0).transform(small), lambda: q.and_(0, ">", 0), lambda: q.filter(0, ">", 0).filter(0, ">", 1)):
        with pytest.raises(schema.DataError):
            bad()


def test_json(spark, small, tmp_path):
    assert json_io.load(spark, json_io.dump(small)).count() == 2
    with pytest.raises(schema.DataError):
        json_io.load(spark, '{"cols": 3, "data": {"a": [1]}}')
    (tmp_path / "a.json").write_text(json_io.dump(small))
    assert {r["id"]: r["point"] for r in json_io.read_json(spark, str(tmp_path / "a.json")).collect()}["one"] == [5, 6, 7, 8, 9]
    model = scalers.Standardize().fit(small)
    assert json_io.load_model(json_io.dump_model(model)) == model


def test_scalers_invert(small):
    for model in (scalers.Normalize(), scalers.Standardize(), scalers.RobustScale()):
        fitted = model.fit(small)
        back = fitted.inverse_transform(fitted.transform(small)).orderBy("pos").collect()
        assert np.allclose([r["point"] for r in back], [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]])
        assert np.allclose(fitted.inverse_transform_point(fitted.transform_point([1, 2, 3, 4, 5])), [1, 2, 3, 4, 5])


def test_kmeans_by_hand(spark):
    ds = schema.from_rows(spark, [("a", [0, 0]), ("b", [0.5, 0]), ("c", [0.5, 1]), ("d", [1, 1])])
    model = clustering.KMeans(2, 2, means=[[0.0, 0.0], [1.0, 1.0]]).fit(ds)
    assert model.means == [[0.25, 0.0], [0.75, 1.0]]
    assert [r["cluster"] for r in model.predict(ds).orderBy("pos").collect()] == [0, 0, 1, 1]
    for kind in (clustering.KMeans, clustering.SKMeans):
        for init in ("assignment", "points", "sampling"):
            moved = ds.withColumn("point", F.transform("point", lambda v: v + 0.1))
            assert kind(2, 1, init, 42).fit(moved).means == kind(2, 1, init, 42).fit(moved).means


def test_mlp_one_step():
    model = networks.MLP((2,), "sigmoid", "sigmoid", 1, 0.1, 0.0, 1, 0.0)
    model.weights = [np.array([[0.1, 0.2], [0.3, 0.1], [0.5, 0.0]]), np.array([[0.1], [0.2]])]
    model.biases = [np.array([0.1, 0.1]), np.array([1.0])]
    x, y = np.array([[0.6, 0.8, 0.7]]), np.array([[0.0]])
    layers = model.outputs(x)
    assert np.allclose(layers[1], [[0.6791786992, 0.5744425168]]) and np.allclose(layers[2], [[0.7654329236]], atol=1e-4)
    out = layers[2][0, 0]
    grad = 2 * out * out * (1 - out)
    model.train(x, y)
    assert np.allclose(model.weights[1][:, 0], np.array([0.1, 0.2]) - 0.1 * grad * layers[1][0])


def test_training_survives_nan():
    model = networks.MLP((2,)).start(1, 1)
    before = [w.copy() for w in model.weights]
    x = np.zeros((64, 1))
    x[31] = np.nan
    assert model.train(x, x) == -1 and all((a == b).all() for a, b in zip(before, model.weights, strict=True))


def test_pca_round_trip(spark):
    x = np.random.default_rng(0).normal(size=(40, 4))
    ds = schema.from_rows(spark, [(str(i), p) for i, p in enumerate(x)])
    model = reduction.PCA(4).fit(ds)
    back = model.inverse_transform(model.transform(ds)).orderBy("pos").collect()
    assert np.allclose([r["point"] for r in back], x)
    assert abs(model.explained() - 1) < 1e-12
    assert len({tuple(r["point"]) for r in reduction.grid(reduction.mds(ds)).collect()}) == 40
    with pytest.raises(schema.DataError):
        reduction.UMAP(k=40).fit_transform(ds)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_mds_by_blocks_of_distances(spark, metric):
    x = np.random.default_rng(1).normal(size=(300, 5))
    x[:40] = x[0]
    ds = schema.from_rows(spark, [(str(i), p) for i, p in enumerate(x)])
    whole = [r["point"] for r in reduction.mds(ds, 2, metric).orderBy("pos").collect()]
    blocks = [r["point"] for r in reduction.mds(ds, 2, metric, most=100).orderBy("pos").collect()]
    assert np.allclose(blocks, whole, atol=1e-8 * np.abs(whole).max())


@pytest.mark.parametrize("oversample, extent", [(1, 0), (3, 0), (1, 50), (1, 7)])
def test_grid_without_a_matrix_of_costs(spark, oversample, extent):
    x = np.random.default_rng(2).normal(size=(150, 2))
    x[:30] = x[0]
    ds = schema.from_rows(spark, [(str(i), p) for i, p in enumerate(x)])

    def total(most):
        cells = np.array([r["point"] for r in reduction.grid(ds, oversample, extent, most=most).orderBy("pos").collect()])
        assert len({tuple(c) for c in cells}) == 150
        across = extent or int(np.ceil(np.sqrt(150 * oversample)))
        down = -(-150 * oversample // across)
        placed = (x - x.min(axis=0)) / np.ptp(x, axis=0) * [across - 1, down - 1]
        return ((placed - cells) ** 2).sum()

    assert np.isclose(total(10), total(2000), rtol=1e-12)


def test_grid_above_the_former_limit(spark):
    x = np.random.default_rng(3).normal(size=(2100, 2))
    ds = schema.from_rows(spark, [(str(i), p) for i, p in enumerate(x)])
    assert len({tuple(r["point"]) for r in reduction.grid(ds).collect()}) == 2100


def test_buffers(spark):
    frames = schema.unpack(schema.buffer(spark, {"a": [[1, 2, 3], [4, 5, 6]]}))
    order = lambda df: [r["value"] for r in df.orderBy("chan", "frame").collect()]
    assert order(buffers.flatten(frames, "frames")) == [1, 2, 3, 4, 5, 6]
    assert order(buffers.flatten(frames)) == [1, 4, 2, 5, 3, 6]
    assert order(buffers.mono(frames)) == [5, 7, 9]
    assert order(buffers.select(frames, [2, 0], [1])) == [6, 4]
    assert order(tables.to_buffer(tables.from_buffer(frames))) == order(frames)
    assert order(buffers.compose(frames, frames, 1, 1, 2)) == [1, 2, 4, 2, 3, 4, 5, 10, 5, 6]
    assert buffers.spikes_to_times(frames.where("value > 9").union(frames.limit(1).withColumn("value", F.lit(0.0)))).collect()[0]["onset"] == -1


def test_stats_edges(spark):
    frames = schema.unpack(schema.buffer(spark, {"a": [2, 2, 2], "b": [7]}))
    rows = {(r["buffer_id"], r["order"]): r for r in stats.buf_stats(frames, 2).collect()}
    assert rows["a", 0]["std"] == 0 and rows["a", 0]["skewness"] == 0 and rows["b", 1]["mean"] == 0
    found = stats.exact_ranks(spark.range(101).selectExpr("id % 1 AS key", "double(id) AS value"), [25.0, 50.0, 99.0]).collect()
    assert {r["percent"]: r["value"] for r in found} == {25.0: 25.0, 50.0: 50.0, 99.0: 99.0}


def test_labels(spark):
    ls = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, "x")], schema.LABELSET)
    model = labels.LabelEncoder.fit(ls)
    assert model.labels == ["x", "y"]
    assert [r["label"] for r in model.decode(model.one_hot(ls)).orderBy("pos").collect()] == ["x", "y", "x"]
    other = spark.createDataFrame([("d", 0, "?")], schema.LABELSET)
    assert model.index(other).first()["index"] == -1 and model.one_hot(other).first()["point"] == [0.0, 0.0]


def test_signals_in_spark(spark, tmp_path):
    import wave

    i = np.arange(8000)
    bufs = schema.buffer(spark, {"a": [np.sin(i * 0.06), np.cos(i * 0.06)], "b": np.sin(i * 0.1)})
    spectra = signals.stft(bufs)
    back = {(r["buffer_id"], r["chan"]): r["samples"] for r in signals.istft(spectra, 8000).collect()}
    assert np.allclose(back["b", 0][1024:-1024], np.sin(i * 0.1)[1024:-1024], atol=1e-5)
    assert {r[0] for r in signals.corpus(bufs).select(F.size("point")).collect()} == {168}
    assert signals.decomposed(bufs, "hpss").count() == 9
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.sin(i * 0.1) * 32000).astype("<i2").tobytes())
    row = audio.read_audio(spark, str(tmp_path)).first()
    assert row["sample_rate"] == 8000 and len(row["samples"]) == 8000


def test_model_files(spark, tmp_path):
    import json

    import numpy as np

    from ondelys.operators import clustering, kdtree, networks, reduction, scalers

    ds = from_rows(spark, [(f"p{i}", [float(i), float(i * i % 7), 1.5 * i % 4]) for i in range(24)])
    named = ds.selectExpr("id", "pos", "IF(pos < 12, 'low', 'high') AS label")
    tree = kdtree.KDTree.fit(ds)
    keys = {
        "tree rows cols data ids": tree,
        "tree labels": kdtree.KNNClassifier.fit(ds, named),
        "tree target": kdtree.KNNRegressor.fit(ds, ds),
        "means rows cols": clustering.KMeans(2, 3, "points", 7).fit(ds),
        "data_min data_max min max cols": scalers.Normalize(-1.0, 1.0).fit(ds),
        "data_low data_high median range low high cols": scalers.RobustScale().fit(ds),
        "mean std cols": scalers.Standardize().fit(ds),
        "bases rows cols values mean numpoints": reduction.PCA(2).fit(ds),
        "labels rows": labels.LabelEncoder.fit(named),
        "mlp labels": networks.MLPClassifier(networks.MLP((3,), "tanh", "sigmoid", 3)).fit(ds, named),
        "embedding rows cols tree ids a b k": reduction.UMAP(k=4, iterations=3).fit_transform(ds)[0],
    }
    for names, model in keys.items():
        text = json_io.dump_model(model)
        assert set(json.loads(text)) == set(names.split())
        back = json_io.load_model(text, spark=spark)
        assert type(back) is type(model) and json_io.dump_model(back).split('"a"')[0] == text.split('"a"')[0], names
    network = keys["mlp labels"].model
    back = json_io.load_model(json_io.dump_model(network))
    assert np.allclose(back.outputs(np.eye(3))[-1], network.outputs(np.eye(3))[-1])
    for bad in ("", "[]", "{}", '{"means": 3}', '{"tree": [1], "rows": 1, "cols": 1, "data": [[1]], "ids": []}'):
        with pytest.raises(DataError):
            json_io.load_model(bad)
    json_io.write_json(ds, str(tmp_path / "ds.json"))
    json_io.write_json(named, str(tmp_path / "ls.json"))
    rows = json_io.read_json(spark, str(tmp_path / "ds.json")).collect()
    assert sorted(r["pos"] for r in rows) == list(range(24)) and {r["id"]: r["point"] for r in rows} == {r["id"]: r["point"] for r in ds.collect()}
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] == sorted(r["id"] for r in rows)
    assert {r["id"]: r["label"] for r in json_io.read_json(spark, str(tmp_path / "ls.json"), label=True).collect()} == {r["id"]: r["label"] for r in named.collect()}


def test_tree_against_brute_force():
    import numpy as np

    from ondelys.operators.kdtree import KDTree

    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 3))
    points[50:60] = points[50]
    tree = KDTree.build([str(i) for i in range(300)], points)
    for q in points[:20]:
        far = np.sqrt(((points - q) ** 2).sum(axis=1))
        assert np.allclose([d for _, d in tree.near(q, 5)], np.sort(far)[:5])
        assert {n for n, _ in tree.near(q, 0, 0.7)} == {str(i) for i in np.flatnonzero(far < 0.7)}
    grown = tree.add("new", [0.0, 0.0, 0.0])
    assert grown.near([0.0, 0.0, 0.0], 1) == [("new", 0.0)] and len(tree.ids) == 300


@pytest.mark.parametrize("width", [2, 9])
def test_nearest_by_leaves(spark, width):
    import numpy as np

    from ondelys.operators import neighbors

    rng = np.random.default_rng(width)
    points = np.round(rng.normal(size=(600, width)) * (1 if width > 2 else 4), 0 if width == 2 else 3)
    ds = from_rows(spark, [(f"p{i}", p.tolist()) for i, p in enumerate(points)])
    queries = from_rows(spark, [(f"q{i}", p.tolist()) for i, p in enumerate(points[:70] + 0.25)])
    far = np.sqrt(((points[None] - (points[:70] + 0.25)[:, None]) ** 2).sum(axis=2))
    for k, radius in ((4, 0.0), (5, 1.0), (0, 0.8)):
        got = {}
        for r in sorted(neighbors.nearest(ds, queries, k, radius, leaf=40).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append(r["id"])
        for q in range(70):
            order = [i for i in np.lexsort((np.arange(600), far[q])) if not radius or far[q][i] < radius]
            assert got.get(f"q{q}", []) == [f"p{i}" for i in (order[:k] if k else order)], (k, radius, q)


def test_neighbour_widths_and_sparse_start(spark):
    import numpy as np

    from ondelys.operators import reduction

    rng = np.random.default_rng(3)
    rows = np.sort(rng.uniform(0.5, 3, (40, 10)), axis=1)
    width = reduction.neighbour_widths(rows, 10)
    assert np.allclose(np.exp(-(rows[:, 1:] - rows[:, :1]) / width[:, None]).sum(axis=1), np.log2(10), atol=1e-4)
    # Two directed graphs, and a ring whose spectral start is a circle, dense and by iteration.
    i, j, w = reduction.fuzzy_union(np.array([0, 1, 2]), np.array([1, 0, 0]), np.array([0.5, 0.4, 0.3]), 3)
    assert {(a, b): round(c, 9) for a, b, c in zip(i.tolist(), j.tolist(), w.tolist(), strict=True)} == {(0, 1): 0.7, (1, 0): 0.7, (0, 2): 0.3, (2, 0): 0.3}
    n = 1200
    at = np.arange(n)
    near = [(at + d) % n for d in (1, -1, *range(2, 60), *range(-59, -1))]
    y = reduction.spectral_start(np.tile(at, len(near)), np.concatenate(near), np.ones(n * len(near)), n, 2, rounds=400)
    assert np.ptp(np.linalg.norm(y, axis=1)) < 0.02 * np.linalg.norm(y, axis=1).mean()


def test_catalog_and_corpus(spark):
    from ondelys import catalog
    from ondelys.operators import tables

    held = catalog.Catalog()
    held.put("one", from_rows(spark, [("a", [1.0]), ("b", [2.0])]))
    held.put("two", from_rows(spark, [("b", [3.0]), ("c", [4.0])]))
    assert held.call(tables.merge, "one", "two").count() == 3
    with pytest.raises(DataError):
        held.call(tables.merge, "one", "three")
    corpus = catalog.corpus_add(catalog.corpus_entry(spark, [("x", "a", 2, 3)]), "y", "a", 0, 1)
    corpus = catalog.corpus_update(corpus, "y", "a", 4, 2)
    assert catalog.corpus_get(corpus, "y") == ("a", 4, 2) and catalog.corpus_delete(corpus, "x").count() == 1
    frames = spark.range(6).selectExpr("'a' AS buffer_id", "0L AS chan", "id AS frame", "id * 1.0D AS value")
    assert sorted((r["buffer_id"], r["frame"], r["value"]) for r in catalog.corpus_frames(corpus, frames).collect()) == [("x", 0, 2.0), ("x", 1, 3.0), ("x", 2, 4.0), ("y", 0, 4.0), ("y", 1, 5.0)]
    with pytest.raises(DataError):
        catalog.corpus_get(corpus, "z")


def test_midi_of_silence_in_the_query(spark):
    from ondelys.functions import vectors

    row = spark.createDataFrame([(0.0,)], "v double").select(vectors.hz_to_midi(F.col("v")).alias("a"), F.round(vectors.hz_to_midi(F.col("v"), float("-inf")), 6).alias("b")).first()
    assert row["a"] == -999 and row["b"] == float("-inf")


def test_a_json_file_is_read_by_lines(spark, tmp_path, monkeypatch):
    from ondelys.schema import DataError
    from ondelys.sources import json_io

    named = spark.createDataFrame([('a"],\n}}', 0, "x"), ("}}", 1, '],"'), ("é", 2, None), ("d", 3, "{")], "id string, pos long, label string")
    path = str(tmp_path / "set.json")
    json_io.write_json(named, path)
    text = (tmp_path / "set.json").read_text()
    import json

    assert json.loads(text) == {"cols": 1, "data": {r["id"]: [r["label"]] for r in named.collect()}}
    parsed = json_io._by_lines(spark, path, "string")
    assert parsed is not None and parsed.count() == 4
    back = json_io.read_json(spark, path, label=True).orderBy("pos").collect()
    assert [(r["id"], r["label"]) for r in back] == sorted((r["id"], r["label"]) for r in named.collect())
    (tmp_path / "cut.json").write_text(text[:-2])
    with pytest.raises(DataError):
        json_io.read_json(spark, str(tmp_path / "cut.json"), label=True)


def test_ties_of_a_tree_by_position_and_by_id(spark):
    from ondelys.operators import kdtree, neighbors
    from ondelys.sources import json_io

    ds = from_rows(spark, [(f"p{(i * 7) % 40}", [float(i % 3), float(i % 2)]) for i in range(40)])
    tree = json_io.load_model(json_io.dump_model(kdtree.KDTree.fit(ds))).placed(ds)
    want = {(r["query"], r["rank"]): r["id"] for r in neighbors.nearest(ds, ds, 9).collect()}
    for r in tree.query(ds, 9).collect():
        assert r["ids"] == [want[r["id"], k] for k in range(1, 10)] == [n for n, _ in tree.near(r["point"], 9)]
    by_id = tree.by_id().query(ds, 2).where("id = 'p5'").first()
    same = sorted(r["id"] for r in ds.collect() if r["point"] == by_id["point"])
    assert by_id["ids"] == same[:2]


@pytest.mark.parametrize("k", [3, 0])
def test_a_tree_compares_blocks_of_bounded_size(k):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from ondelys.operators.kdtree import KDTree

    points = np.random.default_rng(0).normal(size=(30_000, 4))
    tree = KDTree([str(i) for i in range(30_000)], points)
    asked = pa.RecordBatch.from_arrays([pa.array(points[: 600 if k else 80].tolist())], ["point"])
    tracemalloc.start()
    rows = 0
    for part, found in tree._found(asked, k, 0.0):
        for (nodes, distance), i in zip(found, range(rows, rows + part.num_rows), strict=True):
            assert nodes[0] == i and distance[0] == 0 and len(nodes) == (k or 30_000)
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All at once would be 144 MB a matrix, of which several are held.
    assert rows == (600 if k else 80) and peak < (130 if k else 600) * 1e6


def test_scalar_functions_of_any_value(spark, tmp_path):
    from ondelys.plans.registry import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    inf = float("inf")
    values = [None, float("nan"), inf, -inf, 0.0, -0.0, 5e-324, -1.0, -699.5, -700.0, -701.0, 29.27, 440.0, 215571431.1127542]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))

    def strict(rows):
        # Not a number isn't null here; the two libraries' powers of ten may differ in their last digit.
        return [[repr(x) for x in r[:4]] + [None if r[4] is None else f"{r[4]:.12g}"] for r in rows]

    names = "event_id, mel, midi, db, amp"
    got = QUERIES["scalar_functions"](spark, str(tmp_path)).select(*names.split(", ")).orderBy("event_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert strict(got) == strict(con.execute(f"SELECT {names} FROM ({ORACLES['scalar_functions']}) ORDER BY event_id").fetchall())


@pytest.mark.parametrize("listed", [1, 5, 48])
def test_least_cells_by_short_lists(spark, listed):
    from ondelys.operators.assignment import assign, assign_cells

    rng = np.random.default_rng(listed)
    for n, across, down in ((1, 1, 1), (90, 10, 9), (100, 9, 12), (120, 20, 20)):
        x = np.exp(2 * rng.normal(size=(n, 2)))
        x[: n // 3] = x[0]
        placed = (x - x.min(axis=0)) / np.maximum(np.ptp(x, axis=0), 1e-12) * [across - 1, down - 1]
        cost = ((placed[:, None] - np.array([(c, r) for r in range(down) for c in range(across)])[None]) ** 2).sum(axis=2)
        cells = assign_cells(spark, placed, across, down, listed)
        assert len(set(cells.tolist())) == n
        assert np.isclose(cost[np.arange(n), cells].sum(), cost[np.arange(n), assign(cost)].sum(), rtol=1e-12)


def test_grid_of_many_equal_points_ends_soon(spark):
    import time

    x = np.random.default_rng(4).normal(size=(3000, 2))
    x[:1500] = x[0]
    ds = schema.from_rows(spark, [(str(i), p) for i, p in enumerate(x)])
    began = time.time()
    assert len({tuple(r["point"]) for r in reduction.grid(ds).collect()}) == 3000
    assert time.time() - began < 60
