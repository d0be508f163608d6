"""Schemas and configuration of the evaluation engine."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

#: A label manifest; label 1 is the positive (attack) class.
MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("is_digital", T.BooleanType()),
        T.StructField("type", T.StringType()),
    ]
)
SUBMISSION = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.DoubleType())])
#: Fixed value: file extensions of images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
LABEL_NAMES = {0: "genuine", 1: "fraud"}
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitConfig:
    """How items are split; ``near_dup_threshold`` is passed on to duplicate detection."""

    test_frac: float = 0.15
    val_frac: float = 0.15
    n_folds: int = 5
    random_state: int = 42
    near_dup_threshold: int = 10

    @classmethod
    def of(cls, values: dict) -> SplitConfig:
        """From a stored manifest; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})
