"""Mixing sources to target weights with hash thresholds, without sorting documents.

Every document has a hash. What a source has to give beyond whole copies is found as a
threshold on that hash: sizes are summed by source and hash bucket, the bucket in which
the budget ends is split into finer buckets, and so on until it holds one hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.common import WORD
from quillmap.operators.numbering import total_before
from quillmap.session import materialise

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
HASH_BITS = 60
#: A bucket is split into 2 ** BUCKET_BITS.
BUCKET_BITS = 12


def document_size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def document_hash() -> Column:
    """60 bits of the id and the text; rows that agree in both are taken or left together."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target from (source, size) rows.

    Sources in order of code points, null last, weigh `weights` in turn and share the sum
    of all sizes; what goes beyond `most` times a source's size is shared by weight among
    the rest until no target is above. A source without words has target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total_before(
        by_source.withColumns({"_last": F.col("source").isNull(), "_one": F.lit(1)}), ["_last", "source"], "_one", "_rank"
    )
    cycle = F.array(*(F.lit(w) for w in weights))
    table = materialise(
        ranked.select("source", "source_size", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).alias("weight"))
    )
    exact = "decimal(38,0)"
    full = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weight = full[0] or 0, full[1] or 1  # of the sources that are not at their limit
    while True:
        at_limit = F.col("weight").cast(exact) * F.lit(left).cast(exact) > F.col("source_size").cast(exact) * F.lit(
            most * weight
        ).cast(exact)
        limited = table.where(at_limit).agg(F.sum("source_size"), F.sum("weight")).first()
        now = ((full[0] or 0) - most * (limited[0] or 0), (full[1] or 1) - (limited[1] or 0))
        if now == (left, weight):
            break
        left, weight = now
    target = F.when(at_limit, (F.col("source_size") * most).cast("double")).otherwise(
        F.lit(left).cast("double") * F.col("weight") / F.lit(weight)
    )
    return table.select("source", "source_size", target.alias("target"))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target, copies, threshold from written (source, size, hash) rows.

    Of a source, every document is taken `copies` times and those whose hash is below
    `threshold` once more.
    """
    targets = source_targets(sized, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialise(
        targets.withColumn("copies", whole.cast("long")).withColumn(
            "rest", F.col("target") - F.col("copies") * F.col("source_size")
        )
    )
    # where the budget of a source ends: rows whose hash >> shift is `prefix`, of which `rest` words are still to take
    ends = plan.where("rest > 0").select(
        "source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("threshold")
    )
    ends = materialise(ends)
    found, shift = [], HASH_BITS
    while True:
        inside = sized.alias("d").join(
            ends.alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.hash", shift) == F.col("e.prefix")),
        )
        shift -= BUCKET_BITS
        buckets = inside.groupBy(
            F.col("d.source").alias("source"), "rest", F.shiftright("d.hash", shift).alias("bucket")
        ).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # 2 ** BUCKET_BITS rows a source at most
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = materialise(buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))))
        last = placed.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        one = F.col("low") == F.col("high")
        nearer = 2 * F.col("before") + F.col("words") < 2 * F.col("rest")
        found.append(
            last.where(one).select("source", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("threshold"))
        )
        # budgets that end with a bucket, or beyond the last one by a rounding
        found.append(
            placed.groupBy("source", "rest")
            .agg(F.sum("words").alias("all"), F.max("high").alias("high"))
            .where(F.col("all") <= F.col("rest"))
            .select("source", (F.col("high") + 1).alias("threshold"))
        )
        ends = materialise(
            last.where(~one).select(
                "source",
                (F.col("rest") - F.col("before")).alias("rest"),
                F.col("bucket").alias("prefix"),
                F.col("low").alias("threshold"),
            )
        )
        if not shift or ends.isEmpty():
            break
    thresholds = found[0]
    for more in found[1:]:
        thresholds = thresholds.unionByName(more)
    return materialise(
        plan.alias("p")
        .join(thresholds.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left")
        .select("p.source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", document_size().alias("size"), document_hash().alias("hash"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document.

    Null texts have size 0. A source's taken words differ from its target by half a
    document at most (or half the rows that agree in id and text, which go together).
    Only ids, sizes and hashes are written; other columns are not read.
    """
    sized = materialise(sized_documents(docs))
    plan = mixing_plan(sized, weights, most)
    copies = F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * copies).alias("taken"),
            copies.cast("long").alias("copies"),
        )
    )


def take_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The rows of the mix with all their columns; a document taken twice comes twice."""
    plan = mixing_plan(materialise(sized_documents(docs).drop("doc_id")), weights, most)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("_from"), document_hash().alias("_hash"))
    copies = F.col("copies") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)
    return (
        rows.join(plan, F.col("_from").eqNullSafe(F.col("source")))
        .select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy"))
        .select("row.*")
    )
