import functools
import random
import zlib

import numpy as np
import pytest
from conftest import DATA, same

from ondelys.llm import mixing, packing, tokenids, wavelet
from ondelys.llm.queries import ORACLES, QUERIES
from ondelys.scratch import stage

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "  ", "a  b\n\n c's 'T", "naïve İstanbul", "日本語 text", "x" * 200 + " y", "½ ²", "a b", "é", "''s !'s 12 3", "tab\tnew\r\nline", "a" * 5000, None]


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokens(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["op2_mix_sources", "op10_url_filter"])
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck, ORACLES[name])


def test_targets_by_hand(spark):
    docs = spark.createDataFrame([(i, "w " * n, s, "x") for i, (s, n) in enumerate([("a", 10), ("a", 30), ("b", 50), (None, 10), ("c", 0)])], "doc_id long, text string, source string, taken string")
    rows = mixing.mix_plan(docs).collect()
    # 100 words for 5 : 2 : 1 : 5 over a, b, c, null; a stops at 120, c at 0, null at 30.
    level = {"a": 5 * 70 / 7, "b": 2 * 70 / 7, "c": 0, None: 30}
    assert {r["source"]: round(r["target"], 9) for r in rows} == {k: round(v, 9) for k, v in level.items()}
    for s, want in level.items():
        assert sum(r["taken"] for r in rows if r["source"] == s) == round(want)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_plan(docs.where("false")).count() == 0
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {0, 1, 2, 3}
    assert mixing.mix_documents(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).count() == 2


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_library(path, monkeypatch):
    encoder = tokenids.Encoder(path)
    assert encoder.rule is not None
    rnd = random.Random(0)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab 'st\n!é12,.") for _ in range(rnd.randrange(80))) for _ in range(300)] + ["<|endoftext|> x"]
    for size in (1 << 20, 50):
        monkeypatch.setattr(tokenids, "SEGMENT", size)
        for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokens(path, text), text


def test_bins():
    rnd = random.Random(1)
    lengths = sorted([rnd.randint(1, 100) for _ in range(3000)], reverse=True)
    bins, used = packing.OpenBins(100, 5000), {}
    for n in lengths:
        b, at = bins.place(n)
        assert at == used.get(b, 0)
        used[b] = at + n
    assert max(used.values()) <= 100 and len(used) <= sum(lengths) / 100 * 1.02 + 1
    few = packing.OpenBins(100, 2)
    for n in lengths:
        few.place(n)
    assert few.open <= 2
    with pytest.raises(ValueError):
        bins.place(101)


def test_packing_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "y"), (None, "null id", "z"), (50, "word " * 9000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    found = packing.pack_documents(docs, WORDS).collect()
    want = []
    for i, t, _ in rows:
        ids = [*tokens(WORDS, t), 1]
        want += [(str(i), k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    ends = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r["length"] for r in found) // 4096)
    assert packing.pack_documents(docs.where("false"), WORDS).count() == 0
    whole = packing.sequences(docs.where("doc_id < 5"), WORDS).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(tokens(WORDS, t)) + 1 for t in ODD[:5]) + len(tokens(WORDS, ODD[3])) + 1


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    for n, m in ((0, 5), (1, 1), (700, 3), (5000, 50257), (1025, 70000)):
        a = rng.integers(0, m, n).astype(np.uint32)
        data = wavelet.write_shard(wavelet.WaveletMatrix.build(a), pa.table({"doc_id": [1], "n_tokens": [n]}), {})
        w = wavelet.read_shard(data)[0]
        assert (w.decode() == a).all() and (w.access(np.arange(n)) == a).all()
        for t in [*a[:3].tolist(), m + 5]:
            assert w.count(t) == (a == t).sum() and (w.occurrences(t) == np.flatnonzero(a == t)).all()
            assert w.rank(t, n // 2) == (a[: n // 2] == t).sum()


def test_token_files(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "another text", "y"), (40, "word " * 3000, "z"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = f"file://{tmp_path}/tokens"
    found = wavelet.token_files(docs, BYTES, folder, shard_tokens=200).collect()
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tokens(BYTES, t), 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    # The two rows with id 3 may come either way round.
    assert [g for g in got if g[0] != 3] == [w for w in want if w[0] != 3]
    assert sorted(g[3] for g in got if g[0] == 3) == sorted(w[3] for w in want if w[0] == 3)
    assert wavelet.lookup(spark, folder, 0).count() == len(rows)
    assert wavelet.token_files(docs.where("false"), BYTES).count() == 0


def test_pieces_with_one_hash_keep_their_ids():
    # Complementary Thue-Morse words share any polynomial hash modulo 2**64.
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    for size in (1024, 2048):
        one, other = ("".join("ab"[x ^ flip] for x in word) for flip in (0, 1))
        for name in (WORDS, BYTES):
            texts = [one, other, f"x {one} {other} y", "plain text", f"{other} {other}"]
            got = [ids.tolist() for ids in tokenids.encode_documents(name, texts, 7)]
            assert got == [[*tokens(name, t), 7] for t in texts]
        word += [1 - x for x in word]


def test_pieces_without_ids_are_dealt_over_groups(spark):
    parts = stage(spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "10L AS length", "1L AS ids_crc32"), "parts")
    got = [r["n"] for r in packing.pack(parts, 4096, 100, 500).selectExpr("sequence_id >> 40 AS g").groupBy("g").agg({"*": "count"}).toDF("g", "n").collect()]
    assert len(got) == 6 and max(got) < 1000


def test_mix_without_ids_stays_near_its_target(spark):
    # Source b has a target of a part of its size, and its rows share one id, or none, and one text.
    rows = [(i, "w " * 10, "a") for i in range(40)] + [(None, "w " * 7, "b")] * 30 + [(None, "v " * 3, "b")] * 30 + [(1, f"u{i} x", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r["source"]: r["target"] for r in mixing.mix_plan(docs).select("source", "target").distinct().collect()}
    got = {}
    for r in mixing.mix_documents(docs).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(got.get(s, 0) - t) <= 10 for s, t in targets.items()) and sum(targets.values()) == 400 + 300 + 40
    assert mixing.mix_plan(docs).count() == len(rows)
