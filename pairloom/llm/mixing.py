"""Mix sources to target weights by thresholds on a hash, without sorting rows.

Each source has a budget of words. Whole repeats of the source are taken by arithmetic;
for the rest, words are summed by source and hash bucket, the bucket that the budget ends
in is found, and only the rows of that bucket are summed again by the next digit of the
hash. The thresholds are nested: a document taken under a small budget is also taken
under every larger one, and copy k + 1 of a document comes only with copy k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.columns import carried, restored
from pairloom.operators.ranking import with_position
from pairloom.session import write_once

# The hash has five digits of twelve bits.
DIGIT_BITS, DIGITS = 12, 5
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def key_hash(key: Column, seed: int) -> Column:
    """60 bits of an md5 of the key, as long; a null key hashes like an empty one."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGIT_BITS * DIGITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``sizes`` (``_source``, ``_source_size``) with ``_target``: a share of the total by weight.

    Weights are dealt in code-point order of the sources, null last, repeating. A target
    stops at ``max_repeats`` times its source; what it leaves is shared again by weight. The
    level that weights are multiplied with is found by raising it until no further source
    stops; each step is one aggregate over the table of sources.
    """
    ranked = with_position(sizes.withColumn("_last", F.col("_source").isNull()), ["_last", "_source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("_source_size") * F.lit(max_repeats)
    table = write_once(ranked.select("_source", "_source_size", weight.alias("_weight"), cap.alias("_cap")), "sources")
    level, stopped = 0.0, -1
    while True:
        stops = F.col("_cap") < F.lit(level) * F.col("_weight")
        at = table.agg(
            F.coalesce(F.sum("_source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(stops, F.col("_cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~stops, F.col("_weight"))), F.lit(0)).alias("open"),
            F.count_if(stops).alias("stopped"),
        ).first()
        if at["stopped"] == stopped or at["open"] == 0:
            break
        level, stopped = (at["total"] - at["capped"]) / at["open"], at["stopped"]
    return table.withColumn("_target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight"))).drop("_cap")


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _open_bucket(rows: DataFrame, budgets: DataFrame, digit: int) -> DataFrame:
    """Per source, the bucket at this digit in which its remaining budget ends.

    ``budgets`` has ``_s``, ``_prefix`` (the hash digits settled so far) and ``_left`` (words
    still to take below that prefix). At most 4,096 buckets a source are put in order.
    """
    shift = DIGIT_BITS * (DIGITS - 1 - digit)
    inside = rows.join(budgets, _same_source("_source", "_s")).filter(
        F.shiftright("_hash", shift + DIGIT_BITS) == F.col("_prefix")
    )
    buckets = inside.groupBy("_s", "_left", F.shiftright("_hash", shift).alias("_bucket")).agg(
        F.sum("_size").alias("_words"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high")
    )
    upto = F.sum("_words").over(
        W.partitionBy("_s").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ends = buckets.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_left"))
    first = ends.groupBy("_s").agg(
        F.min_by(F.struct("_bucket", "_words", "_low", "_high", "_left", "_upto"), "_bucket").alias("b")
    )
    left = F.col("b._left") - (F.col("b._upto") - F.col("b._words"))
    return first.select("_s", "b._bucket", "b._words", "b._low", "b._high", left.alias("_left"))


def mix_to_targets(
    df: DataFrame,
    source: str,
    size: str,
    key: str,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """All rows and columns of ``df`` with ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` (int, 0 to ``max_repeats``) says how often the row is in the mix and ``taken``
    is ``copies * size``. A source's taken words differ from its target by at most half of
    the document that its budget ends in; of rows with one and the same key that document
    is all of them, since they cannot be told apart by hash. A null source is a source of
    its own and comes last; a null key hashes like an empty one; a null size counts as 0.
    Rows of size 0 follow the threshold like others and count nothing; a source without any
    word has target 0 and no copies. An empty table gives an empty result. Input columns
    with an added name are replaced.
    """
    prepared = carried(
        df,
        _source=F.col(source),
        _size=F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")),
        _hash=key_hash(F.col(key), seed),
    )
    words = write_once(prepared.select("_source", "_size", "_hash"), "mix")
    sizes = words.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    full = F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size")), F.lit(max_repeats)))
    budgets = targets.withColumn("_full", F.coalesce(full, F.lit(0)).cast("int")).withColumn(
        "_left", F.col("_target") - F.col("_full") * F.col("_source_size")
    )
    settled = write_once(budgets, "budgets")
    # Nothing is left to find where whole repeats fill the target.
    still = settled.filter((F.col("_left") > 0) & (F.col("_full") < max_repeats)).select(
        F.col("_source").alias("_s"), F.lit(0).cast("long").alias("_prefix"), "_left"
    )
    cuts = None
    for digit in range(DIGITS):
        found = write_once(_open_bucket(words, still, digit), "cuts")
        single = (F.col("_low") == F.col("_high")) | F.lit(digit == DIGITS - 1)
        # The document at the border goes in if that is nearer to the target.
        last = F.when(F.col("_left") * 2 >= F.col("_words"), F.col("_high")).otherwise(F.col("_low") - 1)
        done = found.filter(single).select(F.col("_s").alias("_cut_source"), last.alias("_cut"))
        cuts = done if cuts is None else cuts.unionByName(done)
        still = found.filter(~single).select("_s", F.col("_bucket").alias("_prefix"), "_left")
        if still.isEmpty():
            break
    # One row per source, written so that Spark knows the size when it picks the join.
    plan = write_once(
        settled.join(cuts, _same_source("_source", "_cut_source"), "left").select(
            F.col("_source").alias("_plan_source"), "_source_size", "_target", "_full", "_cut"
        ),
        "plan",
    )
    copies = F.col("_full") + F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)).cast("int")
    return restored(
        prepared.join(plan, _same_source("_source", "_plan_source")),
        df.columns,
        source_size=F.col("_source_size"),
        target=F.col("_target"),
        copies=copies,
        taken=copies * F.col("_size"),
    )
