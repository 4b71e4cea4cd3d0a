"""Declared schemas of the canonical tables.

A polygon part is one row holding its ring; the ring is the smallest unit any
geometry operator needs whole, so most of them are narrow column expressions.
Operators that meet a grid (fields, patches, cells) explode rings to `VERTICES`.
"""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

POINT = StructType([StructField("i", DoubleType()), StructField("j", DoubleType())])
RING = ArrayType(POINT)


def _table(*columns: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns])


IMAGES = _table(
    ("image_id", LongType()),
    ("city", StringType()),
    ("number", IntegerType()),
    ("fold", StringType()),
    ("pixelsize", DoubleType()),
    ("height", IntegerType()),
    ("width", IntegerType()),
    ("gt", ArrayType(DoubleType())),
    ("epsg", IntegerType()),
    ("min_ds_fac", IntegerType()),
)
POLYGONS = _table(
    ("image_id", LongType()),
    ("source", StringType()),
    ("poly_id", LongType()),
    ("part", IntegerType()),
    ("ring", RING),
    ("props", MapType(StringType(), StringType())),
)
VERTICES = _table(
    ("image_id", LongType()),
    ("source", StringType()),
    ("poly_id", LongType()),
    ("part", IntegerType()),
    ("k", IntegerType()),
    ("i", DoubleType()),
    ("j", DoubleType()),
)
PATCHES = _table(
    ("image_id", LongType()),
    ("ds_fac", IntegerType()),
    ("patch_id", IntegerType()),
    ("r0", IntegerType()),
    ("c0", IntegerType()),
    ("r1", IntegerType()),
    ("c1", IntegerType()),
)
CELLS = _table(
    ("image_id", LongType()),
    ("source", StringType()),
    ("layer", StringType()),
    ("i", IntegerType()),
    ("j", IntegerType()),
    ("value", DoubleType()),
)
PIXELS = _table(
    ("image_id", LongType()),
    ("band", IntegerType()),
    ("i", IntegerType()),
    ("j", IntegerType()),
    ("value", DoubleType()),
)
FIELD = _table(
    ("image_id", LongType()),
    ("map_id", IntegerType()),
    ("i", IntegerType()),
    ("j", IntegerType()),
    ("di", DoubleType()),
    ("dj", DoubleType()),
)
CURVES = _table(
    ("source", StringType()),
    ("image_id", LongType()),
    ("map_id", IntegerType()),
    ("metric", StringType()),
    ("threshold", DoubleType()),
    ("value", DoubleType()),
)
VIEWS = _table(("view_id", StringType()), ("angle", DoubleType()))
RUNS = _table(("run_name", StringType()), ("ts", TimestampType()), ("path", StringType()))


def require(df, *columns: str):
    """Fail early, with the missing names, when a table lacks columns an operator reads."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; table has {df.columns}")
    return df
