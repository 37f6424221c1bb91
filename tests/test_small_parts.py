import pytest

from ondelys import catalog, params, schema
from ondelys.signal.latency import latency


def test_catalog(spark):
    held = catalog.Catalog()
    ds = schema.from_rows(spark, [("a", [1.0])])
    held.put("mine", ds)
    assert held.get("mine") is ds and spark.sql("SELECT count(*) FROM mine").first()[0] == 1 and held.names() == ["mine"]
    held.drop("mine")
    with pytest.raises(schema.DataError):
        held.get("mine")
    assert catalog.corpus_entry(spark, [("x", "a", 0, 10)]).count() == 1


def test_params_are_clipped():
    declared = {"low": params.Param(20, (params.at_least(0), params.below("high"))), "high": params.Param(100), "size": params.Param(3, (params.odd,))}
    assert params.settled(declared, {}) == {"low": 20, "high": 100, "size": 3}
    with pytest.warns(UserWarning):
        assert params.settled(declared, {"low": 200, "size": 4}) == {"low": 100, "high": 100, "size": 5}
    with pytest.raises(TypeError):
        params.settled(declared, {"other": 1})


def test_latency():
    assert latency("mfcc") == 1024 and latency("onset_slice") == 512 and latency("novelty_slice") == 512 * 4
    assert latency("hpss") == 16 * 512 + 1024 and latency("transients") == 364 and latency("amp_gate", min_above=440, look_back=24) == 464


def test_settings_are_clipped():
    from ondelys.params import Changes, clipped

    with pytest.warns(UserWarning, match="clipped"):
        assert clipped({"win": 2, "harm_size": 4, "fft": 3, "other": "x"}) == {"win": 4, "harm_size": 5, "fft": 4, "other": "x"}
    assert clipped({"win": 64, "hop": -1, "fft": -1}) == {"win": 64, "hop": -1, "fft": -1}
    changes = Changes()
    assert [changes.changed(*v) for v in ((2, "a"), (2, "a"), (3, "a"), (2, "a"))] == [True, False, True, True]


def test_progress_and_cancellation(spark):
    import threading
    import time

    from ondelys.progress import task

    with task(spark, "counting") as now:
        assert now.progress() == 0.0
        spark.range(1000).selectExpr("sum(id)").collect()
        time.sleep(0.5)
        assert now.progress() > 0.0

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(60)
            yield batch

    with task(spark, "endless") as now:
        threading.Timer(3, now.cancel).start()
        began = time.time()
        with pytest.raises(Exception):  # noqa: B017 - the error that Spark raises for cancelled jobs
            spark.range(10).mapInArrow(slow, "id long").collect()
        assert now.cancelled and time.time() - began < 50


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from ondelys import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    there = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"), conf=conf)
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_root(there)
