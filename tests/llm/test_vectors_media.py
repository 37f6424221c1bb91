import numpy as np
import pytest

from ondelys.llm import crosspoly, media


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[40:60] = x[40]  # a group of copies that holds a query
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, [1.0] * 3), (None, rows[1][1]), rows[7]]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, score string")
    found = crosspoly.nearest(frame).collect()
    hit = 0
    y = x.astype(float)
    for q in range(0, 400, 20):
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and q not in [r["vec_id"] for r in got]
        assert np.allclose([r["score"] for r in got], [y[q] @ y[r["vec_id"]] for r in got], atol=1e-12)
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(400), -s))[:20]) & {r["vec_id"] for r in got})
    assert hit / 400 >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 40), key=lambda r: r["rank"])][:19] == list(range(41, 60))


def brute_nearest(rows, k, step):
    """Lists of (vec_id, score) by query."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in range(0, max(ids) + 1, step):
        for own in x[ids == q]:
            score = (x * own).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_ties_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (3000, 14)).astype(float)
    x[:, 0] = 1.0
    ids = rng.permutation(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = by_query(crosspoly.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect())
    want = brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    # What is found at all is in the right order; where all true scores are found, so are the smallest ids.
    full = [q for q in want if [s for _, s in got[q]] == [s for _, s in want[q]]]
    assert len(full) >= 0.95 * len(want)
    rough = crosspoly._best_of_block(np.arange(4), x[:4], ids, x, 20, {})
    for q in range(4):
        score = x @ x[q]
        assert rough[1][rough[0] == q].tolist() == ids[np.lexsort((ids, -score))[:20]].tolist()
    every = by_query(crosspoly.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=10**6).collect())
    assert every == want


@pytest.mark.parametrize("cell", [crosspoly.CELL, 40])
def test_recall_on_the_given_vectors(spark, cell):
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables here")
    frame = spark.read.parquet(str(DATA / "embeddings.parquet"))
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got, want = by_query(crosspoly.nearest(frame, cell=cell).collect()), brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_cells_grow_with_the_vectors(spark):
    # Near neighbours: a few probes of many cells find them.
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 16))
    rows = [(i, (centres[i % 150] + rng.normal(size=16) * 0.15).tolist()) for i in range(4500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folded = frame.selectExpr("vec_id AS rep", "embedding AS vec", "vec_id AS q")
    lengths = [np.linalg.norm(v) for _, v in rows]
    hasher, probes, met = crosspoly.tuned(folded, folded, 16, 4500, max(lengths), True, 20, 4, 16, 0.96, 7)
    assert hasher.hashes == 2 and met >= 0.96 and probes < hasher.cells_of_table / 10
    got, want = by_query(crosspoly.nearest(frame, cell=16, chunk=30).collect()), brute_nearest(rows, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_few_vectors_find_all(spark):
    frame = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    found = sorted(crosspoly.nearest(frame).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in found] == [5, 4, 3, 2, 1]
    assert crosspoly.nearest(frame.where("false")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x)


def test_images_decode():
    grey = media.scene(8)
    whole = np.clip(grey, 0, 255).astype(np.uint8)
    assert (media.decode(media.encode_png(grey)) == whole).all()
    height, width = whole.shape
    assert (media.decode(b"P5\n%d %d\n255\n" % (width, height) + whole.tobytes()) == whole).all()
    for bad in (None, b"", b"junk", media.encode_png(grey)[:60]):
        assert media.decode(bad) is None
    assert len(media.describe(np.full((40, 40), 9.0))[0]) == 0


def test_bad_images_are_unreadable():
    import struct
    import zlib

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def png(kind, width=9, height=9, body=b"", palette=b""):
        head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + palette + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    bomb = zlib.compress(b"\0" * (1 << 24))
    bad = [png(5, body=b"\0" * 90), png(3, body=b"\0" * 90), png(3, body=b"\0" + b"\7" * 89, palette=chunk(b"PLTE", b"\1\2\3")), png(0, 1 << 30, 1 << 30), png(0, 0, 0), png(0, body=b"\0" * 50)]
    bad += [png(0, body=b"\0" * 90)[:40], b"\x89PNG\r\n\x1a\n" + b"\xff" * 99, b"P5\n99999 99999\n255\n", b"P5 -4 4 255 ", b"P6\n2 2\n70000\n" + b"a" * 99, b"P5\n# c\n2 2\n255\n", bomb]
    assert [i for i, b in enumerate(bad) if media.decode(b) is not None] == []


def test_corners_grow_with_the_image():
    large = np.concatenate([np.concatenate([media.scene(i + 10 * j) for i in range(4)]) for j in range(4)], axis=1)
    place, code = media.describe(large)
    assert 10 * media.CORNERS < len(place) <= large.size // media.AREA
    # A sixteenth of a large picture is found in it.
    part, own = media.describe(media.scene(12))
    i, j = np.nonzero(np.bitwise_count(code[:, None] ^ own[None]).sum(axis=2) <= media.NEAR)
    assert media.consensus(place[i], part[j]) >= media.AGREE


@pytest.mark.parametrize("how", [1, 2])
def test_copies_agree_and_others_do_not(how):
    def agreeing(a, b):
        (pa, ca), (pb, cb) = a, b
        i, j = np.nonzero(np.bitwise_count(ca[:, None] ^ cb[None]).sum(axis=2) <= media.NEAR)
        return media.consensus(pa[i], pb[j]) if len(i) >= media.AGREE else 0

    plain = [media.describe(media.scene(i)) for i in range(20)]
    found = [agreeing(plain[i], media.describe(media.edited(media.scene(i), how))) for i in range(20)]
    assert np.mean(np.array(found) >= media.AGREE) >= 0.9
    assert max(agreeing(plain[i], plain[j]) for i in range(20) for j in range(i)) < media.AGREE


def test_copies(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(90, None), (91, b"junk"), (92, b"junk"), (None, bytearray(media.encode_png(media.scene(0)))), (None, None)], "image_id long, image binary")
    images = media.render(vectors).unionByName(odd).selectExpr("*", "'x' AS key", "'y' AS hash", "1 AS part")
    found = media.copies(images).collect()
    assert len(found) == 45 and {r["component_id"] for r in found if r["image_id"] is None} == {0, None}
    rows = {r["image_id"]: (r["component_id"], r["links"]) for r in found if r["image_id"] is not None}
    assert len(rows) == 43 and rows[90] == (90, 0) and rows[91] == rows[92] == (91, 0)
    right = [rows[i][0] == (i if i % 4 == 3 else i - i % 4) for i in range(40)]
    assert np.mean(right) >= 0.9 and all(rows[i][0] == i for i in range(3, 40, 4))
    assert media.copies(images.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [media.BUCKET, 20])
def test_copies_in_hot_buckets(spark, bucket):
    # Versions of one picture, 200 of them, fill their buckets; others with the same box pasted in don't join.
    vectors = spark.range(200).selectExpr("id * 64 + 63 AS vec_id", "array(1.0f) AS embedding")
    others = []
    for i in range(30):
        grey = media.scene(5000 + i)
        grey[-20:, -24:] = media.scene(4999)[-20:, -24:]
        others.append((10**6 + i, bytearray(media.encode_png(grey))))
        others.append((2 * 10**6 + i, bytearray(media.encode_png(grey[8:, 6:] * 0.9 + 9))))
    images = media.render(vectors).unionByName(spark.createDataFrame(others, "image_id long, image binary"))
    rows = {r["image_id"]: r["component_id"] for r in media.copies(images, bucket=bucket).collect()}
    assert np.mean([rows[i * 64 + 63] == 63 for i in range(200)]) >= 0.95
    assert np.mean([rows[2 * 10**6 + i] == 10**6 + i for i in range(30)]) >= 0.9


@pytest.mark.parametrize("bucket", [media.BUCKET, 7])
def test_every_link_is_found(spark, bucket):
    # Families, 14 versions of one picture, pictures with a common part, a large one that holds four of them, and few corners.
    ids = [*range(28), *range(63, 63 + 64 * 14, 64)]
    pictures = {r["image_id"]: bytes(r["image"]) for r in media.render(spark.createDataFrame([(i, [float(i)]) for i in ids], "vec_id long, embedding array<float>")).collect()}
    for i in range(8):
        grey = media.scene(5000 + i)
        grey[-40:, -44:] = media.scene(4999)[-40:, -44:]
        pictures[2000 + i] = media.encode_png(grey)
    pictures[3000] = media.encode_png(np.concatenate([np.concatenate([media.scene(8 * i + 4 * j) for i in range(2)]) for j in range(2)], axis=1))
    pictures[3001] = media.encode_png(np.pad(np.full((12, 12), 200.0), 30))
    corners = {n: media.describe(media.decode(data)) for n, data in pictures.items()}
    links, component = dict.fromkeys(pictures, 0), {n: n for n in pictures}
    names = sorted(pictures)
    for x in names:
        for y in (n for n in names if n > x):
            (pa, ca), (pb, cb) = corners[x], corners[y]
            i, j = np.nonzero(np.bitwise_count(ca[:, None] ^ cb[None]).sum(axis=2) <= media.NEAR)
            pa, pb = (p[k].astype(np.float32).astype(float) for p, k in ((pa, i), (pb, j)))
            if len(i) >= media.AGREE and max(media.consensus(pa, pb), media.consensus(pb, pa)) >= media.AGREE:
                links[x], links[y] = links[x] + 1, links[y] + 1
                least, other = sorted((component[x], component[y]))
                component = {n: least if c == other else c for n, c in component.items()}
    images = spark.createDataFrame([(n, bytearray(data)) for n, data in pictures.items()], "image_id long, image binary")
    found = {r["image_id"]: (r["component_id"], r["links"]) for r in media.copies(images, bucket=bucket).collect()}
    assert sum(links.values()) > 200 and found == {n: (component[n], links[n]) for n in names}


def test_links_are_counted_where_they_are_found():
    import pyarrow as pa

    place, code = media.describe(media.scene(3))
    corners = np.zeros(len(place), media.CORNER)
    corners["code"], corners["place"] = code, place
    n = 120
    rows = {"sub": [1] * n, "block": [0] * 50 + [1] * 70, "image": list(range(n)), "corners": [corners.tobytes()] * n}
    out = pa.Table.from_batches(media._links_kernel(iter([pa.RecordBatch.from_pydict(rows)]))).to_pylist()
    # 3,500 links between the two blocks, but a count for each picture and a tree of edges.
    assert {r["a"]: r["links"] for r in out if r["b"] is None} == {i: 70 if i < 50 else 50 for i in range(n)}
    assert sum(r["b"] is not None for r in out) == n - 1


def test_near_descriptors_in_packed_products():
    # Six descriptors in a number: exact at the limit, for even and odd numbers of ones, all or none, and rows that don't fill a number.
    random = np.random.default_rng(4)
    bits = random.integers(0, 2, (media.ROWS + 700, media.BITS)).astype(np.uint8)
    bits[0], bits[1], bits[2:200] = 0, 1, bits[2]
    for i in range(2, 200):
        bits[i, random.choice(media.BITS, i % 45, replace=False)] ^= 1
    code = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    other = np.concatenate([code[:150], code[-1900:]])
    differing = np.bitwise_count(code[:, None] ^ other[None]).sum(axis=2)
    packed, space = media._packed(code), np.empty(-(-media.ROWS // media.FIELDS) * media.COLUMNS)
    assert sum(map(len, packed)) == media.ROWS // 6 + -(-700 // 6)
    i, j = media._near(packed, other, None, space)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
    found = np.zeros(differing.shape, bool)
    found[i, j] = True
    assert (found == (differing <= media.NEAR)).all() and {39, 40, 41, 42} <= set(differing.ravel().tolist())
