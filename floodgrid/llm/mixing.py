"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash of its id. A source takes every document ``full`` times and,
once more, those whose hash is below the source's threshold. The threshold comes from histograms of
words by (source, hash bucket): the bucket in which the running sum passes the budget is the only one
looked at again, by the next bits of the hash, until it holds one hash value; that value is taken if
this brings the source nearer to its target. Thresholds nest: a larger budget takes a superset.

Nothing is sorted, and no source is a key by itself where rows are many: rows meet by (source,
bucket), after sums on the map side. The per-source plan is broadcast if it has at most
``BROADCAST_SOURCES`` rows, else joined with salt.

Cases: a null or empty text has size 0 and is taken 0 words of; null sources are one source, ordered
last; rows with equal ids share a hash and are taken alike; null ids hash by text; sources without
words have target 0; an empty table gives an empty result; extra columns stay in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.functions.ranking import global_rank
from floodgrid.runtime import write_and_read as materialize

HASH_BITS, LEVEL_BITS = 60, 12
BROADCAST_SOURCES = 20_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text, or of the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``; a capped source's excess goes to the others by weight."""
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "place")
    weights = F.array(*[F.lit(w) for w in cycle])
    weighed = materialize(ranked.withColumn("weight", F.get(weights, ((F.col("place") - 1) % len(cycle)).cast("int"))))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, open_weight, capped = total or 0, all_weights or 0, F.lit(False)
    closed = -1
    while open_weight:
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_weight))
        above = capped | (share > most * F.col("source_size").cast("double"))
        n, size, weight = weighed.where(above).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if n == closed:
            break
        # Literals of the round that closed these sources keep the set from shrinking.
        capped, closed = above, n
        rest, open_weight = (total or 0) - most * (size or 0), all_weights - (weight or 0)
    open_target = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_weight or 1))
    return weighed.withColumn("target", F.when(capped, most * F.col("source_size").cast("double")).otherwise(open_target))


def _bucket(level: int) -> Column:
    """The hash down to this level's bits."""
    return F.shiftright("h", HASH_BITS - LEVEL_BITS * (level + 1))


def _thresholds(slim: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Per source: whole takes ``full`` and the hash ``below`` which a document is taken once more."""
    size, target = F.col("source_size").cast("double"), F.col("target")
    full = F.when(size > 0, F.least(F.floor(target / size), F.lit(most))).otherwise(0).cast("long")
    plan = materialize(
        targets.withColumn("full", full).withColumn(
            "budget", F.when((F.col("full") < most) & (size > 0), target - F.col("full") * size).otherwise(0.0)
        )
    )
    rows = slim.where("size > 0")
    state = plan.select("source", "budget")
    for level in range(HASH_BITS // LEVEL_BITS):
        sums = rows.groupBy("source", _bucket(level).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        # At most 4096 buckets of one source meet.
        order = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("upto", F.sum("words").over(order))
        passed = running.join(state, running["source"].eqNullSafe(state["source"])).where(F.col("upto") > F.col("budget"))
        first = passed.groupBy(running["source"]).agg(
            F.min_by(F.struct("bucket", "words", "low", "high", (F.col("budget") - F.col("upto") + F.col("words")).alias("left")), "bucket").alias("b")
        )
        edge = materialize(first.select("source", "b.*"))
        if edge.where("low <> high").limit(1).count() == 0:
            break
        state = edge.select("source", F.col("left").alias("budget"))
        b = edge.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        rows = materialize(rows.join(b, F.col("source").eqNullSafe(F.col("s")) & (_bucket(level) == F.col("b"))).drop("s", "b"))
    nearer = (2 * F.col("left") > F.col("words")).cast("long")
    cut = edge.select(F.col("source").alias("s"), (F.col("low") + nearer).alias("below"))
    # Without a bucket that passes the budget, all documents are within it.
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "full", F.coalesce("below", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(0)).alias("below")
    )


def mix(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the kept columns), size, source_size, target, ``takes`` and ``taken`` (words).

    Sources in code-point order, nulls last, weigh as ``cycle`` repeats; together they take as many
    words as there are, none over ``most`` times its own.
    """
    columns = documents.columns if keep is None else keep
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        hash60(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"),
    )
    if keep is not None and text not in keep:
        rows = slim = materialize(rows)
    else:
        slim = materialize(rows.select("source", "size", "h"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(_thresholds(slim, _targets(sizes, cycle, most), most))
    plan = plan.withColumnRenamed("source", "s")
    if plan.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") % SALTS == F.col("salt")))
    takes = F.col("full") + (F.col("h") < F.col("below")).cast("long")
    return joined.select("row", "size", "source_size", "target", takes.alias("takes"), (takes * F.col("size")).alias("taken"))
