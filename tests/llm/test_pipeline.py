import pytest
from conftest import DATA

import corpus_pipeline
from ondelys.llm.queries import QUERIES


def test_stages(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, count = docs.columns, docs.count()
    for name, work in corpus_pipeline.STAGES[:-1]:
        docs = work(spark, docs, str(DATA))
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= (3 * count if name == "mix_sources" else count), name
        count = left
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert placed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii_surrogates", "mix_sources", "best_fit_packing"]


CLASHING = ["n_entities", "row", "key", "held", "found", "n", "fp", "node", "c_source", "row_key", "size", "toxic", "of", "h"]


@pytest.mark.parametrize("stage_", range(5))
def test_stages_on_odd_rows(spark, tmp_path, stage_):
    rows = [(1, "some plain words here", "en", "a", 21), (1, "some plain words here", "en", "a", 21), (2, None, None, None, None), (3, "", "en", None, 0), (None, "mail x1@mail.example.com to them", "en", "b", 9), (5, "long text of words " * 30000, "fr", "b", 1), (6, "call +1 (527) 555-9774 now", None, "", 3)]
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{c} string" for c in CLASHING]]))
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, work = corpus_pipeline.STAGES[stage_]
    out = work(spark, docs, str(tmp_path))
    found = out.collect()
    assert work(spark, docs.where("false"), str(tmp_path)).count() == 0
    if name == "best_fit_packing":
        assert {r["doc_id"] for r in found} == {1, 2, 3, None, 5, 6}
        return
    assert out.columns == docs.columns and all(r["row"] == "x" for r in found)
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in found)
    if name == "simhash_near_dedup":
        assert ids == [-1, 1, 2, 5, 6]  # the texts without words are equal, and so are the repeated rows
    elif name == "mix_sources":
        assert set(ids) <= {-1, 1, 5, 6} and 5 in ids
    else:
        assert ids == [-1, 1, 1, 2, 3, 5, 6]
    if name == "pii_surrogates":
        texts = " ".join(r["text"] or "" for r in found)
        assert "x1@mail" not in texts and "555-9774" not in texts


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert QUERIES[name](spark, str(DATA)).count() > 0
