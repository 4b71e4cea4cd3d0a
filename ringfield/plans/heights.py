"""Building heights from several views, stored as a property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.functions import rings
from ringfield.operators.metrics import building_heights
from ringfield.sources.writers import attach_props, write_features


def heights_with_props(
    views: DataFrame, angles: dict[str, float], first_view: str, pixelsize: float, factor: float = 1.0,
    name: str = "HEIGHT", images: DataFrame | None = None, out: str | None = None,
) -> DataFrame:
    """Polygons of the first view with the height written over one property, and the ring in metres.

    With `images` and `out` the features are also saved.
    """
    heights = building_heights(views.select("view_id", "image_id", "poly_id", "ring"), angles, pixelsize, factor)
    base = views.where(F.col("view_id") == first_view).select("image_id", "poly_id", "ring", "props")
    values = heights.select("image_id", "poly_id", F.col("height").alias("value"))
    tagged = attach_props(base, values, name)
    if images is not None and out is not None:
        write_features(tagged, images, out)
    return tagged.join(heights.select("image_id", "poly_id", "height"), ["image_id", "poly_id"]).withColumn(
        "metric_ring", rings.scale(F.col("ring"), F.lit(float(pixelsize)))
    )
