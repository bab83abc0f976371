"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, target over size
of the source. The copies expected so far, summed up along the source's
documents, plus one random offset per source, cross an integer boundary now and then: each
crossing emits the document once. Documents stand in the order of their sizes
and, among sizes alike, of a digest, so that what is taken of a source comes near
its target whatever its sizes.

The running sum needs each document's rank in its source. A source may hold most
of all rows, so it is cut into buckets along that order; ranks inside a bucket and
counts of the buckets before it add up to the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.llm.common import stored, word_count

#: Copies are counted in these units, so that all of the running sum is whole numbers.
UNIT_BITS = 24


def size_class(size: Column) -> Column:
    """Number of digits and the first two of them: grows with the size, classes are within a tenth for large sizes."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds ``number``, ``target``, ``rate`` and ``offset`` to rows ``source``, ``source_size`` (one per source).

    Weights repeat along the sources in code point order, null last. Targets are
    weight times a common level, but ``most`` times the source's size at
    most; the level is where they add up to ``share`` of all sizes. Along sources by
    ascending limit per weight, the level if all before are at their limit rises up
    to the true one and falls afterwards, so the true one is the largest.
    """
    everything = Window.partitionBy()
    listed = sizes.select(
        "source",
        "source_size",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("number"),
        F.sum("source_size").over(everything).alias("total"),
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    listed = listed.withColumns({"weight": weight, "limit": limit}).withColumn("full_at", F.col("limit") / F.col("weight"))
    along = Window.orderBy("full_at", "number")
    before = F.coalesce(F.sum("limit").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = listed.withColumn("level", (F.col("total") * F.lit(float(share)) - before) / left)
    listed = listed.withColumn("target", F.least("limit", F.max("level").over(everything) * F.col("weight")))
    units = F.lit(float(1 << UNIT_BITS))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * units)).otherwise(F.lit(0).cast("long"))
    return listed.select("source", "source_size", "number", "target", rate.alias("rate"))


def _planned(
    docs: DataFrame, carried: Sequence[Column], source: str, text: str, key: str, weights, share, most, seed, bucket_rows
) -> DataFrame:
    """``doc`` (a struct of the carried columns), ``size``, ``source_size``, ``target``, ``copies`` per row of docs."""
    shown = F.coalesce(F.col(text), F.lit(""))
    sized = stored(
        docs.select(
            F.struct(*carried).alias("doc"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), shown)).alias("place"),
        ).withColumn("class", size_class(F.col("size"))),
        "mix",
    )
    classes = sized.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "mix_classes")
    sizes = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")))), 1, UNIT_BITS // 4), 16, 10)
    sizes = sizes.withColumn("offset", offset.cast("long")).withColumnRenamed("source", "of_source")
    classes = stored(
        classes.join(sizes, F.col("source").eqNullSafe(F.col("of_source"))).select(
            F.col("source").alias("of_source"),
            F.col("class").alias("of_class"),
            "number", "source_size", "target", "rate", "offset",
            F.ceil(F.col("n") / bucket_rows).alias("buckets"),
        ),
        "mix_targets",
    )
    in_class = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class"))
    spread = F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32)
    dealt = sized.join(classes, in_class).withColumn("bucket", spread)
    bucket = ["number", "class", "bucket"]
    before = Window.partitionBy("number").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(*bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy(bucket).orderBy("place"))
    crossed = lambda at: F.shiftright(at * F.col("rate") + F.col("offset"), UNIT_BITS)
    ranked = dealt.join(starts, bucket).withColumn("rank", rank)
    copies = crossed(F.col("rank")) - crossed(F.col("rank") - 1)
    return ranked.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix_plan(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 2000,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` is the number of words, 0 for a null or empty text; ``taken`` is size
    times the copies the mix holds. A null source is a source of its own, the last
    one. Sources whose texts are all empty have target 0. Reruns give the same
    rows; rows repeated with the same key and text may swap their copies. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    planned = _planned(docs, [F.col(key).alias("key")], source, text, key, weights, share, most, seed, bucket_rows)
    return planned.select(
        F.col("doc.key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 2000,
) -> DataFrame:
    """The mixed documents: rows of ``docs``, all columns, each as often as ``mix_plan`` says (also not at all)."""
    planned = _planned(docs, [F.col(name) for name in docs.columns], source, text, key, weights, share, most, seed, bucket_rows)
    emitted = planned.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return emitted.select("doc.*")
