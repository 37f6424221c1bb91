"""Near-duplicates by shingle similarity, found through SimHash.

The radius of two bits that op 4's contract sets is far below what a Jaccard
similarity of 0.8 leaves (about ten bits of 64, up to twenty), and tables by
bits can't reach so far.  Here documents meet under ``KEYS`` minimum hashes of
their shingles: at a similarity of 0.8 all of eight miss with a chance of
0.2 ** 8.  Under a key SimHash fingerprints are compared bit-sliced, with the
wide radius; a key of more than ``SPLIT`` fingerprints is dealt over chunks, of
which each two meet.  What such links reach makes a group, and inside a group
the exact Jaccard similarity decides every pair within the radius that isn't
joined already; only links that pass leave a task.

A group of more than ``CROWD`` members or ``BLOCK`` bytes of shingle sets is
settled in three passes, each exact in what it joins: its members in chunks,
then one of each component found, then, only where more than one component is
left, every member outside the largest component against all others that share
a minimum hash with it and are near enough in size and fingerprint.  The last
is found out from fingerprints first, and only sets with such a partner travel
once more.  So a group of copies, however large, sends each set once or twice,
and more travels for what is alike and still doesn't join alone.

Equal word sequences are folded first, and rows are known by ``doc_id`` and
text together; see :func:`keep_one` for nulls and repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .components import components
from .memory import released
from .simhash import CHUNK, SEED, _links_kernel
from .urlfilter import build_filter, may_contain
from .words import split_words

WIDTH = 5
SIMILARITY = 0.8
KEYS = 8
RADIUS = 20
#: Bytes of shingle sets, and members, of a group that one task settles.
BLOCK, CROWD = 1 << 24, 4096
#: Fingerprints under one key that one task compares.
SPLIT = 1 << 16
#: Rows without sets, of a crowded group's third pass, that one task compares.
PEERS = 1 << 14
#: Odd multipliers make further minimum hashes of one hash.  They are unrelated to each other: under multiples of one
#: another the same shingles tend to be the least, and documents that miss one key miss them all.
MIX = [xxhash.xxh64_intdigest(f"key{k}", SEED) | 1 for k in range(KEYS)]


def shingle_hashes(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, str]:
    """Hashes of all shingles of a whole text, and a digest of its word sequence."""
    words = split_words((text or "").encode("utf-8", "surrogatepass").lower())
    joined = b" ".join(words)
    digest = hashlib.md5(joined).hexdigest()
    if not words:
        return np.zeros(0, np.uint64), digest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    width = min(width, len(words))
    view, hash_ = memoryview(joined), xxhash.xxh64_intdigest
    starts, ends = (end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    return np.array([hash_(view[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64), digest


def sketch(hashes: np.ndarray) -> tuple[int, list[int]]:
    """SimHash fingerprint and minimum hashes of distinct shingle hashes."""
    if not len(hashes):
        return 0, []
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = []
    for m in MIX:
        mixed = (hashes ^ hashes >> np.uint64(29)) * np.uint64(m)
        keys.append(int((mixed ^ mixed >> np.uint64(32)).min()))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]), keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exact_links(prints: np.ndarray, sets: list[np.ndarray], similarity: float, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join all pairs within ``RADIUS`` whose exact Jaccard similarity passes.

    Members with one label are joined already.  First each that nothing has
    reached is compared with all others, nearest fingerprints first; then those
    outside the largest component are, as all links left have an end there.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    start = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(known), bool), np.unique(labels, return_inverse=True)[1]
    reached, asked, out = np.zeros(n, bool), np.zeros(n, bool), []

    def ask(x: int) -> None:
        asked[x] = True
        apart = np.bitwise_count(prints ^ prints[x])
        # The similarity of two sets is at most the ratio of their sizes.
        fits = np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x])
        near = np.flatnonzero((apart <= RADIUS) & fits & (label != label[x]))
        near = near[np.argsort(apart[near], kind="stable")]
        own = ids[start[x] : start[x] + size[x]]
        mark[own] = True
        step = 4
        while len(near):
            now, near = near[:step], near[step:]
            both = np.array([np.count_nonzero(mark[ids[start[y] : start[y] + size[y]]]) for y in now.tolist()])
            for y in now[both >= similarity * (size[x] + size[now] - both)].tolist():
                if label[y] != label[x]:
                    out.append((x, y))
                    reached[y] = True
                    label[label == label[y]] = label[x]
            near = near[label[near] != label[x]]
            step *= 2
        mark[own] = False

    for x in range(n):
        if not reached[x]:
            ask(x)
    main = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    for x in range(n):
        if not asked[x] and label[x] != label[main]:
            ask(x)
    return out


def _exact_kernel(similarity: float):
    # Sorted by (root, p, q, node): a group ends where any of the first three changes.
    def links(nodes: list[int], labels: list[int], prints: list[int], sets: list[bytes]) -> pa.RecordBatch:
        found = exact_links(np.array(prints, np.int64).view(np.uint64), [np.frombuffer(x, np.uint64) for x in sets], similarity, np.array(labels))
        a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])
        for batch in released(batches):
            for root, p, q, *row, shingles in zip(*[c.to_pylist() for c in batch.columns[:6]], batch.column(6), strict=True):
                if (root, p, q) != group:
                    if len(held[0]) > 1:
                        yield links(*held)
                    group, held = (root, p, q), ([], [], [], [])
                if held[0] and held[0][-1] == row[0]:  # a repeated row
                    continue
                for column, value in zip(held, (*row, shingles.as_py()), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield links(*held)

    return kernel


def _near(nodes: DataFrame, split: int) -> DataFrame:
    """Links (a, b) between fingerprints that meet under a key and are within the radius."""
    keyed = nodes.select(F.explode("keys").alias("key"), "fp").distinct()
    large = stage(keyed.groupBy("key").count().where(F.col("count") > split).select(F.col("key").alias("large"), F.ceil(F.col("count") / split).alias("parts")), "large-keys")
    dealt = keyed.select("key", F.lit(0).cast("long").alias("sub"), "fp")
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        # Each two chunks of a large key meet under a number of their own.
        places = F.expr("transform(sequence(0L, parts - 1), j -> least(j, part) * parts + greatest(j, part))")
        crowded = keyed.join(large, F.col("key") == F.col("large")).withColumn("part", part).select("key", F.explode(places).alias("sub"), "fp")
        dealt = dealt.join(large, F.col("key") == F.col("large"), "left_anti").unionByName(crowded)
    dealt = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_links_kernel(RADIUS), "a long, b long")


def _settle(texts: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) among ``members`` (root, p, q, node, label, doc_id, same) that share root, p and q."""
    key = F.xxhash64("doc_id", "same")
    # Texts stay where they are: a filter of bounded size says which may be asked for, and only their shingles travel.
    asked = texts.sparkSession.sparkContext.broadcast(build_filter(members.select(key.alias("key")).distinct()))

    def shingle_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            batch = batch.filter(pa.array(may_contain(asked.value, batch.column(3).to_numpy().view(np.uint64)), pa.bool_()))
            hashes = [np.unique(shingle_hashes(t.as_py(), width)[0]) for t in batch.column(2)]
            prints, sets = [_signed(sketch(h)[0]) for h in hashes], [h.tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(sets, pa.binary())], ["of_id", "of_text", "fp", "shingles"])

    sets = texts.select("doc_id", "same", "text", F.xxhash64(key)).mapInArrow(shingle_kernel, "of_id long, of_text string, fp long, shingles binary")
    held = members.join(sets.hint("merge"), (F.col("doc_id") == F.col("of_id")) & (F.col("same") == F.col("of_text")))
    held = held.select("root", "p", "q", "node", "label", "fp", "shingles").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "node")
    return stage(held.mapInArrow(_exact_kernel(similarity), "a long, b long"), "links")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component that the links give each node as its label, staged."""
    roots = components(links).select(F.col("node").alias("linked"), F.col("root").alias("joined"))
    found = members.drop("label").join(roots.hint("merge"), F.col("node") == F.col("linked"), "left")
    return stage(found.withColumn("label", F.coalesce("joined", "node")).drop("linked", "joined"), "labelled")


def _chunks(by: list[str], members: DataFrame, block: int, crowd: int, salt: str) -> DataFrame:
    """``members`` with ``parts``, the number of tasks that those equal in ``by`` need, and ``part``, that of each."""
    parts = F.greatest(F.lit(1), F.ceil(8 * F.sum("size") / block), F.ceil(F.count(F.lit(1)) / crowd)).cast("long")
    counts = members.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(parts.alias("parts"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    condition = same[0] if len(same) == 1 else same[0] & same[1]
    return members.join(counts.hint("merge"), condition).drop(*[f"of_{c}" for c in by]).withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("parts")))


def _group_links(texts: DataFrame, members: DataFrame, nodes: DataFrame, width: int, similarity: float, block: int, crowd: int) -> DataFrame:
    """Links (a, b) that join all near-duplicates among ``members`` (root, node, size, doc_id, same) of each root."""
    dealt = stage(_chunks(["root"], members.withColumn("label", F.col("node")), block, crowd, "first"), "groups")
    links = _settle(texts, dealt.withColumn("p", F.col("part")).withColumn("q", F.col("part")), width, similarity)
    large = stage(dealt.where("parts > 1").drop("parts", "part"), "large-groups")
    if large.isEmpty():
        return links
    # One of each component, as each is joined already.
    large = _labelled(large, links)
    dealt = stage(_chunks(["root"], large.where("node = label"), block, crowd, "second"), "leaders")
    links = stage(links.unionByName(_settle(texts, dealt.withColumn("p", F.col("part")).withColumn("q", F.col("part")), width, similarity)), "links")
    large = _labelled(large, links)
    # Which of them can have a partner at all is told without their sets: a partner meets them under a minimum hash, as
    # everywhere here, and sets of a similarity of 0.8 differ in size by a quarter at most, so they share one of two
    # neighbouring classes of size.
    class_ = F.floor(F.log("size") / F.log(F.lit(1.01 / similarity))).cast("long")
    light = large.join(nodes.select(F.col("node").alias("n"), "fp", "keys").hint("merge"), F.col("node") == F.col("n")).withColumn("class", class_)
    light = light.select("root", "node", "label", "size", "fp", "keys", "class", F.posexplode("keys").alias("k", "key"))
    light = light.withColumn("at", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("root", F.xxhash64("root", "k", "key", "at"))
    light = light.select("root", "node", "label", "size", "fp", "keys", F.col("k").cast("long").alias("k"), (F.col("class") < F.col("at")).alias("low"))
    met = stage(light.join(_several(light).select(F.col("root").alias("of")).hint("merge"), F.col("root") == F.col("of"), "left_semi"), "meetings")
    if met.isEmpty():
        return links
    dealt = _against(met, 1 << 62, PEERS, ["label", "size", "fp", "keys", "k", "low"])
    asked = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "node").mapInArrow(_partners_kernel(similarity), "root long, node long").distinct()
    left = stage(asked.join(large.drop("root").withColumnRenamed("node", "n").hint("merge"), F.col("node") == F.col("n")).drop("n"), "left-groups")
    if left.isEmpty():
        return links
    dealt = stage(_against(left, block, crowd, ["label", "doc_id", "same"]), "places")
    return links.unionByName(_settle(texts, dealt, width, similarity))


def _several(rows: DataFrame) -> DataFrame:
    """(root, main) of the roots whose rows have several labels: the label of most."""
    shares = rows.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"))
    return shares.where("labels > 1").select("root", F.col("most.label").alias("main"))


def _against(rows: DataFrame, block: int, crowd: int, columns: list[str]) -> DataFrame:
    """(root, p, q, node, *columns): all rows of a root outside its largest label dealt to meet all others of it."""
    mains = _several(rows).withColumnRenamed("root", "of")
    left = rows.join(mains.hint("merge"), F.col("root") == F.col("of")).withColumn("other", F.col("label") != F.col("main")).drop("of", "main")
    dealt = _chunks(["root", "other"], left, block, crowd, "third")
    counts = dealt.groupBy(F.col("root").alias("of")).agg(F.max(F.when(~F.col("other"), F.col("parts"))).alias("parts_k"), F.max(F.when(F.col("other"), F.col("parts"))).alias("parts_j"))
    dealt = dealt.join(counts.hint("merge"), F.col("root") == F.col("of"))
    # Parts of the largest are numbered from 0, the others' from parts_k.  Where there is one of each, all meet in one task.
    places = F.expr(
        "CASE WHEN parts_k = 1 AND parts_j = 1 THEN array(struct(0L AS p, 0L AS q))"
        " WHEN other THEN concat(transform(sequence(0L, parts_k - 1), i -> struct(i AS p, parts_k + part AS q)),"
        " transform(sequence(0L, parts_j - 1), i -> struct(parts_k + least(i, part) AS p, parts_k + greatest(i, part) AS q)))"
        " ELSE transform(sequence(0L, parts_j - 1), i -> struct(part AS p, parts_k + i AS q)) END"
    )
    return dealt.select("root", F.explode(places).alias("place"), "node", *columns).select("root", "place.p", "place.q", "node", *columns)


def _partners_kernel(similarity: float):
    """(root, node) of the rows, sorted by (root, p, q), that have another label's row near enough in fingerprint and size.

    Two rows that meet under several keys and classes count under the first of them.
    """

    def partners(root: int, node: np.ndarray, label: np.ndarray, size: np.ndarray, prints: np.ndarray, keys: np.ndarray, k: int, low: np.ndarray) -> pa.RecordBatch:
        found, main = np.zeros(len(node), bool), np.unique(label, return_inverse=True)[1]
        main = main == np.bincount(main).argmax()
        for x in np.flatnonzero(~main).tolist():
            near = (np.bitwise_count(prints ^ prints[x]) <= RADIUS) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x])) & (label != label[x])
            near &= ~(low & low[x])
            y = np.flatnonzero(near)
            if len(y):
                y = y[~(keys[y, :k] == keys[x, :k]).any(axis=1)]
                found[y] = True
                found[x] |= len(y) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), root)), pa.array(node[found])], ["root", "node"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in released(batches):
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("root", "p", "q")], axis=1)
            row = [batch.column(c).to_numpy() for c in ("node", "label", "size")] + [batch.column("fp").to_numpy().view(np.uint64)]
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, KEYS)
            k, low = batch.column("k").to_numpy(), batch.column("low").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1), True]).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                if tuple(place[a]) != now:
                    if parts:
                        yield partners(now[0], *(np.concatenate([x[i] for x in parts]) for i in range(5)), at, np.concatenate([x[5] for x in parts]))
                    now, parts, at = tuple(place[a].tolist()), [], int(k[a])
                parts.append((*(c[a:b] for c in row), keys[a:b], low[a:b]))
        if parts:
            yield partners(now[0], *(np.concatenate([x[i] for x in parts]) for i in range(5)), at, np.concatenate([x[5] for x in parts]))

    return kernel


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block: int = BLOCK, crowd: int = CROWD, split: int = SPLIT) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest ``doc_id``.

    Rows are one document if they share ``doc_id`` and text (null: empty), and
    one of them stays, the same in every run; rows that share the id alone are
    different documents.  Texts without words are equal to each other.  A row
    without an id can't be told from others and stays.  Columns are kept.
    """
    same = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", same.alias("same"))

    def sketch_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for t in batch.column(2):
                hashes, digest = shingle_hashes(t.as_py(), width)
                # Distinct shingles, as in the similarity that decides: repeats must not part fingerprints.
                hashes = np.unique(hashes)
                fp, keys = sketch(hashes)
                rows.append((digest, _signed(fp), len(hashes), [_signed(k) for k in keys]))
            digest, fp, size, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.string()), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "digest", "fp", "size", "keys"])

    drawn = stage(texts.select("doc_id", "same", "text").mapInArrow(sketch_kernel, "doc_id long, same string, digest string, fp long, size long, keys array<bigint>"), "sketches")
    nodes = drawn.groupBy("digest").agg(F.min(F.struct("doc_id", "same")).alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")])
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.same", "fp", "size", "keys"), "nodes")
    roots = components(_near(nodes, split)).select(F.col("node").alias("of"), "root")
    placed = nodes.join(roots.hint("merge"), F.col("fp") == F.col("of"), "left").select(F.coalesce("root", "fp").alias("root"), "node", "size", "doc_id", "same")
    placed = stage(placed, "placed")
    several = placed.groupBy(F.col("root").alias("of")).count().where("count > 1")
    members = placed.join(several.hint("merge"), F.col("root") == F.col("of"), "left_semi")
    roots = components(_group_links(texts, members, nodes, width, similarity, block, crowd)).select(F.col("node").alias("linked"), "root")
    # The smallest id of a group stays, with its text.
    joined = nodes.join(roots.hint("merge"), F.col("node") == F.col("linked"), "left").groupBy(F.coalesce("root", "node").alias("group"))
    chosen = stage(joined.agg(F.min(F.struct("doc_id", "same")).alias("least")).select(F.col("least.doc_id").alias("id"), F.col("least.same").alias("of_text")), "kept-ids")
    counted = drawn.groupBy("doc_id", "same").count()
    special = counted.join(chosen.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.col("same") == F.col("of_text")), "left").where("id is null or count > 1")
    special = stage(special.select("doc_id", "same", F.col("id").isNotNull().alias("stays")), "special-ids")
    return _without(docs, special)


def _without(docs: DataFrame, special: DataFrame) -> DataFrame:
    """``docs`` without the special rows that don't stay, and one of each that does.

    Rows that aren't in the filter of special ones pass without a shuffle; the
    others, and what the filter mistakes for them, are folded and decided
    exactly.  What the filter mistakes has no equal, so folding leaves it alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(build_filter(special.select(F.xxhash64("doc_id", "same").alias("key"))))
    columns = docs.columns
    row = F.struct(*[docs[c] for c in columns])
    id_, same = docs["doc_id"].cast("long"), F.md5(F.coalesce(docs["text"], F.lit("")))

    def rows(wanted: bool) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
                may = may_contain(sent.value, batch.column(3).fill_null(0).to_numpy().view(np.uint64)) & known
                yield batch.filter(pa.array(may == wanted, pa.bool_()))

        hashed = docs.select(row.alias("row"), id_.alias("id"), same.alias("of_text"), F.when(id_.isNotNull(), F.xxhash64(F.xxhash64(id_, same))).alias("h"))
        return hashed.mapInArrow(kernel, hashed.schema)

    sure = rows(False).select(*[F.col("row").getField(c).alias(c) for c in columns])
    unsure = rows(True).groupBy("id", "of_text").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    unsure = unsure.join(special.hint("merge"), (F.col("id") == F.col("doc_id")) & (F.col("of_text") == F.col("same")), "left").where("doc_id is null or stays")
    return sure.unionByName(unsure.select(*[F.col("row").getField(c).alias(c) for c in columns]))
