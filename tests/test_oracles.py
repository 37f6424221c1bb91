"""Every query with SQL against DuckDB on the same tables."""

import pytest
from conftest import DATA, same

from ondelys.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck, ORACLES[name])


@pytest.mark.parametrize("name", ["describe_mfcc", "describe_pitch", "slice_amp", "slice_onset", "decompose_hpss", "stft", "pca", "kmeans_fit", "flagship", "audio_transport", "nmf_cross", "nmf_seed", "griffin_lim", "nmf_morph"])
def test_gives_rows(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "ondelys", tmp_path / "ondelys", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
