"""The flagship analysis: how novel is each item, and which attributes go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skeinwork.functions.columns import binarize
from skeinwork.operators.inference import association_tests, holm
from skeinwork.operators.learn import centroid_reconstruction, fit_pca, novelty, reconstruct, rmse


def scored(items: DataFrame, vec: str = "vec", features: int = 0) -> DataFrame:
    """`items` plus error and novelty, by the mean vector or, with `features`, by a linear autoencoder."""
    rec = reconstruct(items, fit_pca(items, features, vec), vec) if features else centroid_reconstruction(items, vec)
    return novelty(rec.withColumn("error", rmse(vec, "reconstruction")).drop("reconstruction"))


def novelty_associations(items: DataFrame, category: str, numeric: list[str], vec: str = "vec", alpha: float = 0.05) -> DataFrame:
    """One row a test: Welch's t of novelty by each value of `category`, Pearson's r with each numeric
    column, and which survive Holm's correction."""
    wide = binarize(scored(items, vec), category)
    flags = [c for c in wide.columns if c.startswith(f"{category}(")]
    return holm(association_tests(wide.drop(vec), [*flags, *numeric], "novelty"), alpha)

