"""Measures of answers against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """A double rounded as SQL engines do, by its scaled value; F.round goes by its shortest decimal text, which differs at ties."""
    scale = F.lit(10.0**places)
    return F.round(value * scale) / scale


def tally(answers: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall over (expected, got) arrays."""
    tp, fp, fn = (F.sum(F.size(x)) for x in (F.array_intersect("expected", "got"), F.array_except("got", "expected"), F.array_except("expected", "got")))
    sums = answers.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.when(a + b > 0, rounded(a / (a + b), 3)).otherwise(1.0)
    return sums.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("fn")).alias("recall"))


def calibration(answers: DataFrame) -> DataFrame:
    """(threshold, n, correct, precision) at every distinct score, from the highest down; answers: (score, correct)."""
    by = answers.groupBy("score").agg(F.count("*").alias("k"), F.sum(F.col("correct").cast("int")).alias("c"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select(F.col("score").alias("threshold"), F.sum("k").over(down).alias("n"), F.sum("c").over(down).alias("correct"))
    return run.withColumn("precision", rounded(F.col("correct") / F.col("n"), 6))


def thresholds(curve: DataFrame, floor: float = 0.95) -> DataFrame:
    """(threshold, before_drop): the least threshold of at least the floor's precision, and the last one before precision first falls below it."""
    fine = F.col("precision") >= floor
    fall = curve.where(~fine).agg(F.max("threshold").alias("fall"))
    return curve.crossJoin(F.broadcast(fall)).agg(F.min(F.when(fine, F.col("threshold"))).alias("threshold"), F.min(F.when(F.col("fall").isNull() | (F.col("threshold") > F.col("fall")), F.col("threshold"))).alias("before_drop"))


def honesty(answers: DataFrame) -> DataFrame:
    """Shares of answers that are right; of answers with several leaders that say so; of wrong ones at high level (poison);
    of tickets outside that are declined. answers: (right, ties, status, level, outside, declined); of nothing, null."""
    share = lambda hit, of: rounded(F.try_divide(F.count_if(hit & of), F.count_if(of)), 6)
    inside = ~F.col("outside")
    return answers.agg(
        share(F.col("right"), inside).alias("accuracy"), share(F.col("status") == "ambiguous", inside & (F.col("ties") > 1)).alias("ambiguity_honesty"),
        share(~F.col("right") & (F.col("level") == "high"), inside).alias("poison"), share(F.col("declined"), F.col("outside")).alias("ood_decline"),
    )


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """(only_first, only_second, same): rows of two runs, repeated ones counted."""
    a, b = first.exceptAll(second).agg(F.count("*").alias("only_first")), second.exceptAll(first).agg(F.count("*").alias("only_second"))
    return a.crossJoin(F.broadcast(b)).withColumn("same", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def incomplete(nodes: DataFrame) -> DataFrame:
    """(flag, n) of nodes that say that something about them is unknown."""
    return nodes.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def coverage(components: DataFrame, covered: DataFrame) -> DataFrame:
    """Share of components with a test."""
    both = components.select("id").distinct().join(covered.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return both.agg(F.count("*").alias("components"), F.count("hit").alias("covered"), rounded(F.try_divide(F.count("hit"), F.count("*")), 6).alias("ratio"))


def untested(components: DataFrame, covered: DataFrame) -> DataFrame:
    return components.join(covered.select("id"), "id", "left_anti")
