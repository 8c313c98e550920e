"""Batch scoring of crops with a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F

from hallwatch.functions import quality
from hallwatch.params import DEFAULTS, Params
from hallwatch.schemas import VECTOR


def score_crops(crops: DataFrame, make_predict_fn: Callable, input_column: str, vector_size: int, input_shape: list[int],
                batch_size: int = 256, p: Params = DEFAULTS) -> DataFrame:
    """Embedding and quality per crop; crops failing a gate get a zero vector and quality 0.

    ``make_predict_fn`` loads the model once per Python worker and returns the batch function.
    Failing crops never reach the model: they are separated before the batch call.
    """
    model = predict_batch_udf(make_predict_fn, return_type=VECTOR, batch_size=batch_size, input_tensor_shapes=[input_shape])
    w, h, sat, lap = (F.col(c) for c in ("width", "height", "mean_saturation", "laplacian_var"))
    graded = crops.withColumn("quality", quality.gated_score(w, h, sat, lap, p))
    zero = F.array_repeat(F.lit(0.0).cast("float"), vector_size)
    good = graded.filter("quality > 0").withColumn("embedding", model(F.col(input_column)))
    bad = graded.filter(~(F.col("quality") > 0) | F.col("quality").isNull()).withColumn("embedding", zero)
    return good.unionByName(bad.withColumn("quality", F.lit(0.0)))
