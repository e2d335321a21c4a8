"""Fixed-length sequences of a stream's sessions, and how badly a linear model of the normal ones reconstructs each."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F


def sequences(events: DataFrame, features: list[str], gap: int, steps: int = 8) -> DataFrame:
    """(stream, session, part, first_id, vector): each full run of ``steps`` events of a session of (stream, at, id, features), step by step.

    A session ends where the next event is more than ``gap`` later; what is left over at its end is no sequence.  A null feature is 0.
    """
    order = Window.partitionBy("stream").orderBy("at", "id")
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) > gap, F.lit(True))
    rows = events.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("stream", "session").orderBy("at", "id")) - 1
    step = F.struct("at", "id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).alias("x"))
    parts = rows.withColumn("part", F.floor(place / steps)).groupBy("stream", "session", "part").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return parts.where(F.size("steps") == steps).select("stream", "session", "part", F.col("steps")[0]["id"].alias("first_id"), F.flatten("steps.x").alias("vector"))


def _square(v: Column) -> Column:
    return F.aggregate(vector_to_array(v), F.lit(0.0), lambda s, x: s + x * x)


def reconstruction_error(rows: DataFrame, normal: Column, components: int) -> DataFrame:
    """``rows`` with ``error``, the mean square of what ``components`` principal components of the ``normal`` rows leave of ``vector``.

    As components are orthonormal, that is the centred vector's square less its projection's.  Vectors have one length; at
    least two rows must be normal.
    """
    vectors = rows.withColumn("_x", array_to_vector("vector"))
    fitting = vectors.where(normal)
    centre = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(fitting)
    model = PCA(k=components, inputCol="_c", outputCol="_p").fit(centre.transform(fitting))
    error = F.greatest(F.lit(0.0), _square(F.col("_c")) - _square(F.col("_p"))) / F.size("vector")
    return model.transform(centre.transform(vectors)).withColumn("error", error).drop("_x", "_c", "_p")
