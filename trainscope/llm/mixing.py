"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainscope.llm.common import stored, table

#: Words of a source by which the solved rates may miss its target.
GAP = 0.5
#: Newton steps at most; each is bracketed, so that the bound is not met in practice.
STEPS = 60
#: Rows of one source and size that are ranked together.
ROWS = 1000


def _targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to ``(key, source, source_size)``: the share by weight, none above ``most`` times its size.

    What a capped source leaves is dealt again by weight to the others, until none is above its cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-sources")
    whole = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        full, open_weight, n = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
                                           F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
                                           F.count(F.when(over, 1))).first()
        if n == capped or not open_weight:
            break
        level, capped = (whole - full) / open_weight, n
    return sources.withColumn("target", F.least("cap", F.lit(level) * F.col("weight")))


def _rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    """Exponential tilt of the rate by size, held below ``most``: most * e^z / (most - 1 + e^z), 1 at z = 0."""
    return F.lit(most) / (1 + (most - 1) * F.exp(-tilt * size / mean))


def _solved(classes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """The tilt of each source at which its expected words equal its target: Newton on the convex dual."""
    totals = sources.where("source_size > 0").join(
        classes.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")), "key")
    none = F.lit(None).cast("double")
    state = stored(totals.select("key", "target", "cap", "mean", F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high")), "mix-tilt")
    for _ in range(STEPS):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size")
        slope = words * F.col("size") / F.col("mean") * rate * (1 - rate / most)
        sums = classes.join(state.select("key", "tilt", "mean"), "key").groupBy("key").agg(
            F.sum(words * rate).alias("got"), F.sum(slope).alias("slope"))
        miss = F.col("target") - F.col("got")
        near = state.join(sums, "key").withColumn("miss", F.when(F.col("target") >= F.col("cap"), 0.0).otherwise(miss))
        low = F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("miss") < 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.coalesce(F.try_divide("miss", "slope"), F.signum("miss") * 8.0)))
        newton = F.col("tilt") + step
        inside = (F.coalesce(newton > low, F.lit(True))) & (F.coalesce(newton < high, F.lit(True)))
        tilt = F.when(F.abs("miss") <= GAP, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        state = stored(near.select("key", "target", "cap", "mean", tilt.alias("tilt"), low.alias("low"), high.alias("high"), "miss"), "mix-tilt")
        if float(state.agg(F.max(F.abs("miss"))).first()[0] or 0) <= GAP:
            break
    return state


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of one source: rates rounded from large sizes to small, the error carried on."""
    rows = rows.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, rate, most in zip(rows["size"], rows["n"], rows["rate"], rows["most"]):
        goal = n * rate * size + carry
        c = min(max(round(goal / size), 0), int(most * n))
        carry = goal - c * size
        copies.append(c)
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "n": rows["n"], "copies": copies})


def mix_sources(docs: DataFrame, weights: list[float], share: float, most: int = 2) -> DataFrame:
    """All columns of ``docs``, and ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` counts the words of the text.  Sources in code point order, null last, have the weights in
    turn, and share ``share`` times all words; a target stops at ``most`` times its source's words and
    the excess is dealt again.  Each source's rates minimise the relative entropy to taking every
    document once, among rates that meet its target in expectation and stay below ``most``.

    A rate depends on source and size only, so the dual is solved on the counts of each source and
    size.  Rounding goes from large sizes to small and carries the error on, so a source misses its
    target by about its smallest documents.  Which documents of one size get the further copy is
    decided by a hash of id and text: reruns agree.  Documents without words have no copy to give and
    get 1.  Columns of ``docs`` with one of the four names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.withColumns({"size": words, "__key": key, "__h": F.xxhash64("doc_id", "text")})
    counted = stored(rows.groupBy(F.col("__key").alias("key"), "source", "size").agg(F.count("*").alias("n")), "mix-classes")
    sources = _targets(counted.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                       weights, share, float(most))
    sources = stored(sources, "mix-targets")
    classes = counted.where("size > 0").select("key", "size", "n")
    solved = _solved(classes, sources, float(most))
    full = F.col("target") >= F.col("cap")
    rated = classes.join(solved, "key").select(
        "key", "size", "n", F.lit(float(most)).alias("most"),
        F.when(full, float(most)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), float(most))).alias("rate"))
    copies = rated.groupBy("key").applyInPandas(_rounded, "key string, size long, n long, copies long")
    copies = stored(copies, "mix-copies")

    dealt = counted.select("key", "size", "n").join(copies.drop("n"), ["key", "size"], "left").join(
        sources.select("key", "source_size", "target"), "key")
    dealt = dealt.select(F.col("key").alias("__key"), "size", "source_size", "target",
                         F.floor(F.coalesce("copies", "n") / F.col("n")).alias("__base"),
                         F.pmod(F.coalesce("copies", "n"), F.col("n")).alias("__rest"),
                         F.ceil(F.col("n") / ROWS).alias("__buckets"))
    rows = rows.join(dealt, ["__key", "size"]).withColumn("__b", F.pmod("__h", "__buckets"))
    rows = rows.repartition("__key", "size", "__b")  # so that one frequent size is ranked in many tasks
    # The place of a document among those of its source and size, in the order of (bucket, hash).
    before = Window.partitionBy("__key", "size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("__key", "size", "__b").agg(F.count("*").alias("__n"))
               .select("__key", "size", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    place = F.row_number().over(Window.partitionBy("__key", "size", "__b").orderBy("__h", "doc_id"))
    rows = rows.withColumn("__place", place).join(offsets, ["__key", "size", "__b"])
    copies = F.col("__base") + (F.col("__before") + F.col("__place") <= F.col("__rest")).cast("long")
    return rows.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 3, 1, 2 to 150 per cent of all words."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
