"""Mixing sources to target weights, in a time-varying order.

Every source has a share of the total, and a schedule that says when in training it is used: its weight at time u of
[0, 1] is ``w * (1 + tilt * (2u - 1))``, so a positive tilt moves it later. The integral of the schedule is the source's
cumulative token demand; it is inverted in closed form to give every text, at its place in its source's own shuffled
order, the time at which the demand reaches it. Sorting by that time by range gives the training order.

Repetition follows from the demand: a source that must give more tokens than it has is gone through again, in another
shuffled order, at most ``max_repeats`` times. Running sums are taken in two steps (within slices of a source, then over
the slices), so that a source that holds most of the corpus is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.encode import count_tokens
from lectern.session import stage


def feed_name(column: str):
    """Feeds are equal after trimming and lower-casing."""
    return F.lower(F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", "")))


def distinct_texts(documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, **tokenizer) -> DataFrame:
    """(id, ``feed``, ``tokens``) of the distinct texts of the targets' feeds. A text found several times belongs to
    the feed of the smallest id that has it. Texts without tokens or id and texts of other or no feeds are left out."""
    wanted = targets.select(feed_name("source").alias("feed")).distinct()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), feed_name(source_col).alias("feed")).filter("id is not null and text is not null and text <> ''")
    rows = rows.join(wanted, "feed")  # the targets are few; Spark broadcasts them by their size
    firsts = rows.groupBy(F.sha2("text", 256).alias("print")).agg(F.min(F.struct("id", "feed")).alias("first"))
    firsts = stage(firsts.select("first.id", "first.feed"), "mix-texts")
    texts = rows.select("id", "text").join(firsts.select("id"), "id", "left_semi")
    return firsts.join(count_tokens(texts, "id", "text", **tokenizer), "id").filter("tokens > 0")


def plan_mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, tilt: float = 0.5) -> DataFrame:
    """One row per target feed: ``weight``, ``max_repeats``, ``available`` tokens, the ``demand`` and the ``tilt``.

    Without a ``total`` it is the largest one at which every feed that has texts can give its weight (feeds without
    texts give nothing, and the weights of the others are scaled to 1). With a ``total`` a feed gives at most what
    ``max_repeats`` allows. A feed's schedule is its ``schedule`` in ``targets``, where there is such a column and a value:
    -1 for early, 1 for late, 0 for even use. Else sources that are repeated most come latest, in [-tilt, tilt] by the rank
    of demand over supply. The weighted mean of all schedules is taken off, so that at each time the weights sum to 1; if
    one would then leave [-1, 1], all are scaled by the same factor.
    """
    given = F.col("schedule").try_cast("double") if "schedule" in targets.columns else F.lit(None).cast("double")
    targets = targets.withColumn("_given", F.when(given.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), given))))
    goal = targets.select(F.col("_given"), feed_name("source").alias("feed"), F.col("weight").cast("double").alias("weight"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))
    goal = goal.groupBy("feed").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("_given").alias("given"))
    have = sizes.groupBy("feed").agg(F.sum("tokens").alias("available"), F.count("*").alias("texts"))
    plan = goal.join(have, "feed", "left").fillna(0, ["available", "texts"])
    one = Window.partitionBy()  # one row a feed: the targets are a short list
    able = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("weight") > 0)
    plan = plan.withColumn("w", F.when(able, F.col("weight")).otherwise(0.0))
    plan = plan.withColumn("w", F.coalesce(F.try_divide("w", F.sum("w").over(one)), F.lit(0.0)))
    capacity = F.col("available") * F.col("max_repeats")
    most = F.lit(float(total)) if total is not None else F.min(F.when(F.col("w") > 0, F.try_divide(capacity, F.col("w")))).over(one)
    plan = plan.withColumn("demand", F.coalesce(F.least(capacity.cast("double"), F.col("w") * most), F.lit(0.0)))
    stretch = F.col("demand") / F.greatest(F.col("available"), F.lit(1))
    rank = F.percent_rank().over(Window.partitionBy().orderBy(stretch, "feed"))
    plan = plan.withColumn("rank", rank)
    share = F.coalesce(F.try_divide(F.col("demand"), F.sum("demand").over(one)), F.lit(0.0))
    plan = plan.withColumn("wish", F.coalesce("given", F.col("rank") * F.lit(float(tilt)), F.lit(0.0))).withColumn("share", share)
    plan = plan.withColumn("tilt", F.col("wish") - F.sum(F.col("share") * F.col("wish")).over(one))
    most = F.greatest(F.lit(1.0), F.max(F.when(F.col("demand") > 0, F.abs("tilt"))).over(one))
    return plan.withColumn("tilt", F.coalesce(F.when(F.col("demand") > 0, F.col("tilt") / most), F.lit(0.0))).select("feed", "weight", "max_repeats", "available", "texts", "demand", "tilt")


def training_order(sizes: DataFrame, plan: DataFrame, seed: int = 1, slice_rows: int = 50_000) -> DataFrame:
    """(``doc_id``, ``feed``, ``use`` from 1, ``tokens``, ``time``) sorted by time. A text is used where the middle of
    its tokens lies within its feed's demand, so a feed misses its demand by less than one text."""
    passes = F.ceil(F.try_divide("demand", "available"))
    rows = sizes.join(plan.filter("demand > 0"), "feed").withColumn("use", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)).cast("int"))))
    rows = rows.filter("use <= max_repeats").withColumn("shuffled", F.xxhash64("id", "use", F.lit(seed)))
    slices = F.greatest(F.lit(1), F.ceil(F.col("texts") / slice_rows)).cast("long")
    rows = rows.withColumn("slice", F.floor((F.shiftrightunsigned("shuffled", 33).cast("double") / 2.0**31) * slices).cast("long"))
    rows = rows.select("id", "feed", "use", "tokens", "available", "demand", "tilt", "shuffled", "slice")
    sums = rows.groupBy("feed", "use", "slice").agg(F.sum("tokens").alias("own"))
    before = Window.partitionBy("feed", "use").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("feed", "use", "slice", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("feed", "use", "slice").orderBy(F.shiftrightunsigned("shuffled", 1), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["feed", "use", "slice"])
    start = (F.col("use") - 1) * F.col("available") + F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    rows = rows.withColumn("q", F.try_divide(start + F.col("tokens") / 2, F.col("demand"))).filter("q <= 1")
    a = F.col("tilt")
    u = F.when(F.abs(a) < 1e-9, F.col("q")).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * F.col("q"))) / (2 * a))
    return rows.withColumn("time", u).select("id", "feed", "use", "tokens", "time").orderBy("time", "id", "use")


def shares(order: DataFrame, plan: DataFrame) -> DataFrame:
    """The shares reached, one row per target feed, feeds without texts included."""
    used = order.groupBy("feed").agg(F.sum("tokens").alias("tokens"), F.max("use").alias("most_uses"), F.countDistinct("id").alias("texts_used"))
    one = Window.partitionBy()
    out = plan.join(used, "feed", "left").fillna(0, ["tokens", "most_uses", "texts_used"])
    return out.select("feed", "weight", "max_repeats", "available", "tokens", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(one)), F.lit(0.0)).alias("share"), "most_uses", "texts_used")
