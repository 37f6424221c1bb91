"""Mixing sources to target weights.

Every document gets a hash-random key.  Documents are sorted by key within
their source, in ranges of the key that are fixed beforehand: the keys are
uniform, so equal ranges hold equal shares of any source, and a source of any
size is dealt over all tasks.  Distributed prefix sums of the sizes (sums per
range, then a running sum inside each range) give every document the number of
words before it, and each source is cut where its budget ends.  A budget above
the source's size repeats whole epochs first.

Defined results:

* null or empty text: size 0, nothing taken;
* null source: a source of its own, last in order;
* the key is a hash of ``doc_id`` (null: empty) and text; rows equal in both
  and in source are folded into one with a count, so any number of them stays
  one row of a range, and taken one after another: each row counts by itself;
* empty table: empty result;
* extra columns: ignored by :func:`mix_plan`, kept by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage
from .words import word_count

#: Equal ranges of the hash key, so the largest source in n rows has n / RANGES rows to a range.
RANGES = 4096
SEED = "mix-1"


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Hash-random key: the first 60 bits of an MD5, as 15 hex digits."""
    empty = F.lit("")
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), empty), F.lit(":"), F.md5(F.coalesce(text, empty)))), 1, 15)


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights dealt to the sources in code-point order, null last.

    One row per source: the source list is configuration-sized.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, cycle)), (F.row_number().over(order) - 1) % len(cycle) + 1)
    return sizes.withColumn("weight", pick.cast("long"))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Targets in words for (source, source_size, weight) rows.

    All sizes together are shared by weight.  A source stops at ``most`` times
    its size and the excess is shared again by weight until none is above: the
    fixed point is a water level, found in closed form.  In order of
    ``most * size / weight`` a prefix of the sources is capped, and the level
    of the rest is what is left over, per unit of weight.
    """
    # Both windows are over the source list, one row per source.
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sizes.withColumn("_total", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_fits", F.col("_total") * F.col("weight") <= cap * F.col("_weights"))
        # The level is that of the first source that isn't capped.
        .withColumn("_rank", F.row_number().over(order))
        .withColumn("_first", F.min(F.when(F.col("_fits"), F.col("_rank"))).over(everything))
        .withColumn("_left", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_total"))).over(everything))
        .withColumn("_share", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_weights"))).over(everything))
    )
    capped = F.col("_first").isNull() | (F.col("_rank") < F.col("_first"))
    target = F.when(capped, cap.cast("double")).otherwise((F.col("_left") * F.col("weight")).cast("double") / F.col("_share").cast("double"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _folded_plan(docs: DataFrame, weights, most: int, seed: str, ranges: int) -> DataFrame:
    """One row per source, key, ``doc_id`` and size, ``n`` documents each, with the words before it."""
    skeleton = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    folded = skeleton.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    folded = stage(folded, "mix-skeleton").withColumn("range", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / F.lit(1 << 24)).cast("int"))
    words = F.sum(F.col("size") * F.col("n"))
    sums = stage(folded.groupBy("source", "range").agg(words.alias("range_size")), "mix-sums")
    targets = source_targets(weights(sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))), most)

    # At most `ranges` rows to a source, however large the source is.
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("o_source"), F.col("range").alias("o_range"), "offset", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    return (
        folded.withColumn("inner", F.coalesce(words.over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .withColumn("start", F.col("offset") + F.col("inner"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )


def mix_plan(docs: DataFrame, weights=cyclic_weights, most: int = 3, seed: str = SEED, ranges: int = RANGES) -> DataFrame:
    """One row per document: size, source_size, target, start, epochs, taken.

    ``weights`` maps (source, source_size) rows to rows with a ``weight``.
    ``taken`` is exact: the taken words of a source sum to its rounded target,
    the document on the cut gives its first words only.
    """
    each = _folded_plan(docs, weights, most, seed, ranges).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    return each.withColumn("taken", taken).select("doc_id", "source", "key", "size", "source_size", "target", "start", "epochs", "rest", "taken")


def mix_documents(docs: DataFrame, weights=cyclic_weights, most: int = 3, seed: str = SEED, ranges: int = RANGES) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them.

    Documents stay whole here: of the document on a source's cut, the whole is
    taken if that ends nearer to the budget.  Only one row per source (its
    epochs and cut key) meets the texts, so texts aren't shuffled.  Where equal
    rows lie on the cut, these alone are counted out.
    """
    plan = _folded_plan(docs, weights, most, seed, ranges)
    # Of n equal documents those are inside whose first half is.
    fits = F.floor((F.col("rest") - F.col("start") - F.col("size") / 2) / F.col("size")) + 1
    inside = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), fits.cast("long")))).otherwise(0)
    last = F.when(inside > 0, F.struct("key", inside.alias("some"), "n"))
    cuts = plan.groupBy(F.col("source").alias("c_source")).agg(F.max("epochs").alias("c_epochs"), F.max(last).alias("c"))
    cuts = stage(cuts.select("c_source", "c_epochs", F.col("c.key").alias("c_key"), F.col("c.some").alias("c_some"), (F.col("c.some") < F.col("c.n")).alias("c_parts")), "mix-cuts")
    # The row travels as one column, so that no name of the input meets one of ours.
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["source"].alias("row_source"),
        random_key(docs["doc_id"], docs["text"], seed).alias("row_key"),
        (word_count(docs["text"]) > 0).alias("filled"),
    )
    joined = rows.join(cuts, F.col("row_source").eqNullSafe(F.col("c_source"))).where("filled")
    whole = (F.col("row_key") < F.col("c_key")) | (F.col("row_key") == F.col("c_key")) & ~F.col("c_parts")
    copies = F.col("c_epochs") + F.coalesce(whole.cast("long"), F.lit(0))
    out = joined.select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("copy")).select("row")
    if not cuts.where("c_parts").isEmpty():
        tied = joined.where("row_key = c_key AND c_parts")
        tied = tied.groupBy("row_source", "c_some", F.sha2(F.to_json("row"), 256).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
        before = Window.partitionBy("row_source").orderBy("same").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("c_some") - F.coalesce(F.sum("n").over(before), F.lit(0))
        tied = tied.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), left)))
        out = out.unionByName(tied.select("row", F.explode(F.array_repeat(F.lit(True), F.col("take").cast("int"))).alias("copy")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same mix in DuckDB SQL.
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS rnk,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighted WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
first AS (SELECT min(rnk) AS first_rnk FROM levels WHERE total * weight <= 3 * source_size * weights),
level AS (SELECT total AS l_total, weights AS l_weights, first_rnk FROM levels, first WHERE rnk = first_rnk),
targets AS (
  SELECT source, source_size,
         CASE WHEN first_rnk IS NULL OR rnk < first_rnk THEN (3 * source_size)::DOUBLE
              ELSE (l_total * weight)::DOUBLE / l_weights::DOUBLE END AS target
  FROM levels LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - start)) END)::BIGINT AS taken
FROM placed
"""
