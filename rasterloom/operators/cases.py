"""Segmentation models: cases, training by folds, prediction; the trainer is the caller's.

A trainer takes a pandas DataFrame of a fold's training voxels and returns bytes; a predictor takes
these bytes and a DataFrame of an image's voxels and returns labels.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Trainer = Callable[[pd.DataFrame], bytes]
Predictor = Callable[[bytes, pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class Model:
    """What training has made: the bytes of each fold, and how cases were named and counted."""

    folds: dict[int, bytes]
    modalities: int
    details: dict[str, object] = field(default_factory=dict)


def sanitised(name: str) -> str:
    """A case's name, with runs of other characters than letters, digits, _ and - as one _; the pattern is a fixed value."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name)


def sanitised_column(name):
    return F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_")


def checked(cases: list) -> list[tuple[str, list, object]]:
    """``[name, volumes, label]`` of each case. Names that are equal once sanitised, and unequal numbers of volumes, are errors."""
    out = []
    for case in cases:
        if len(case) != 3:
            raise ValueError("a case is [name, [volumes], label]")
        name, volumes, label = case
        out.append((sanitised(str(name)), list(volumes) if isinstance(volumes, (list, tuple)) else [volumes], label))
    names = [c[0] for c in out]
    if len(set(names)) < len(names):
        raise ValueError("two cases have one name")
    if len({len(c[1]) for c in out}) > 1:
        raise ValueError("cases have unequal numbers of volumes")
    return out


def duplicates(cases: DataFrame, name: str = "case_id") -> DataFrame:
    """``case_id, n`` of the sanitised names that more than one row has."""
    return cases.groupBy(sanitised_column(F.col(name)).alias("case_id")).agg(F.count("*").alias("n")).where("n > 1")


def binary_labels(labels: DataFrame, value: str = "label") -> DataFrame:
    """Labels of images that have others than 0 and 1 become whether they are above 0; other images stay."""
    odd = F.max(F.when(F.col(value).isin(0, 1), 0).otherwise(1)).over(Window.partitionBy("image_id"))
    return labels.withColumn(value, F.when(odd == 1, (F.col(value) > 0).cast("int")).otherwise(F.col(value)))


def train(voxels: DataFrame, trainer: Trainer, folds: int = 5, modalities: int = 1) -> Model:
    """Train one model for each fold, each in a task of its own, on the images that aren't of the fold.

    ``voxels`` has ``image_id, x, y, z``, values and ``label``. Images are dealt to folds by hash; with
    one fold it is trained on all. The driver gets a model's bytes for each fold.
    """
    own = F.pmod(F.xxhash64("image_id"), F.lit(folds)).cast("int")
    every = voxels.withColumn("_fold", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).withColumn("_own", own)
    used = every if folds == 1 else every.where("_fold <> _own")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [int(part["_fold"].iloc[0])], "model": [trainer(part.drop(columns=["_fold", "_own"]))]})

    rows = used.groupBy("_fold").applyInPandas(run, "fold int, model binary").collect()
    return Model({r.fold: bytes(r.model) for r in rows}, modalities)


def predict(voxels: DataFrame, model: Model, predictor: Predictor, folds: list[int] | None = None, out: str = "label") -> DataFrame:
    """``voxels`` with the label that most folds give; the least of those that tie."""
    chosen = [model.folds[k] for k in folds or sorted(model.folds)]
    names = ", ".join(f"`{c}` {t}" for c, t in voxels.dtypes if c != out)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        votes = np.stack([np.asarray(predictor(m, part), np.int64) for m in chosen])
        part[out] = [int(np.bincount(v).argmax()) for v in votes.T]
        return part

    return voxels.groupBy("image_id").applyInPandas(run, f"{names}, `{out}` bigint")


def env_check() -> dict[str, bool]:
    """Which optional libraries for trainers are there."""
    return {name: importlib.util.find_spec(name) is not None for name in ("torch", "nnunetv2", "onnxruntime", "numpy")}

