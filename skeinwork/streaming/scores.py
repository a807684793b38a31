"""Row-wise scores on streams: what was fitted on a batch is applied to rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.operators.learn import reconstruct, rmse


def score_stream(stream: DataFrame, model, span: tuple[float, float], vec: str = "vec") -> DataFrame:
    """A stream of vectors plus `error` and `novelty`, by a fitted model and the errors' range."""
    lo, hi = span
    out = reconstruct(stream, model, vec).withColumn("error", rmse(vec, "reconstruction")).drop("reconstruction")
    return out.withColumn("novelty", (F.col("error") - lo) / (hi - lo if hi > lo else None))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append; ends when the input at hand is used up."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
