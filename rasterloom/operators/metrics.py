"""Comparing label images: accuracy, confusion, overlap, differences.

Input rows have two values, ``a`` and ``b`` (prediction and truth), and belong to ``image_id``. Use
``voxel.aligned`` to bring two sets of images onto one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pixel_accuracy(pairs: DataFrame, by: str = "image_id") -> DataFrame:
    """``accuracy, correct, total, incorrect``."""
    hit = F.count_if(F.col("a") == F.col("b"))
    return pairs.groupBy(by).agg((hit / F.count("*")).alias("accuracy"), hit.alias("correct"), F.count("*").alias("total"), (F.count("*") - hit).alias("incorrect"))


def confusion_matrix(pairs: DataFrame, classes: int, by: str = "image_id") -> DataFrame:
    """``truth, predicted, n`` for each pair of classes, counted at once and with zeros filled in.

    The counts of an image are one row of at most ``classes`` squared entries, so no classes are
    crossed with the voxels.
    """
    counts = pairs.where(F.col("a").between(0, classes - 1) & F.col("b").between(0, classes - 1)).groupBy(by, (F.col("b").cast("int") * classes + F.col("a").cast("int")).alias("cell")).agg(F.count("*").alias("n"))
    held = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("held"))
    cells = held.select(by, F.explode(F.sequence(F.lit(0), F.lit(classes * classes - 1))).alias("cell"), "held")
    return cells.select(by, F.floor(F.col("cell") / classes).cast("int").alias("truth"), (F.col("cell") % classes).alias("predicted"), F.coalesce(F.try_element_at("held", F.col("cell")), F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame, by: str = "image_id") -> DataFrame:
    """``class, precision, recall, f1`` from a confusion matrix; 0 where one is undefined."""
    cells = matrix.withColumns({"row": F.sum("n").over(Window.partitionBy(by, "truth")), "column": F.sum("n").over(Window.partitionBy(by, "predicted"))})
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    diagonal = cells.where("truth = predicted").select(by, F.col("truth").alias("class"), ratio(F.col("n"), F.col("column")).alias("precision"), ratio(F.col("n"), F.col("row")).alias("recall"))
    return diagonal.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overlap(pairs: DataFrame, label: float = 1, by: str = "image_id") -> DataFrame:
    """``dice, jaccard`` of a label. Dice is NaN if neither image has the label, Jaccard is 0 then."""
    a, b = F.col("a") == label, F.col("b") == label
    both, either = F.count_if(a & b), F.count_if(a | b)
    dice = F.coalesce(F.try_divide(2 * both, F.count_if(a) + F.count_if(b)), F.lit(float("nan")))
    return pairs.groupBy(by).agg(dice.alias("dice"), F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard"), both.alias("intersection"), either.alias("union"))


def compare_arrays(pairs: DataFrame, by: str = "image_id") -> DataFrame:
    """How many values are equal, and mean, mean absolute and extreme differences, of ``b`` from ``a``."""
    d = F.col("b") - F.col("a")
    equal = F.count_if(F.col("a") == F.col("b"))
    return pairs.groupBy(by).agg(
        equal.alias("equal"), (F.count("*") - equal).alias("different"), (100 * equal / F.count("*")).alias("percent_equal"), F.avg(d).alias("mean_diff"),
        F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs_diff"), F.min(d).alias("min_diff"), F.max(d).alias("max_diff"),
    )
