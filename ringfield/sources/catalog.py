"""Image catalogs, names, runs and rounds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def tile_catalog(cities: DataFrame) -> DataFrame:
    """One row per city and number, from `number` or `numbers`; entries with neither are left out.

    Other columns (fold, pixelsize, min_ds_fac) pass through.
    """
    single = F.when(F.col("number").isNotNull(), F.array("number"))
    listed = F.coalesce(single, F.col("numbers"))
    rest = [c for c in cities.columns if c not in ("number", "numbers")]
    return cities.select(*rest, F.explode(listed).alias("number"))


def skipped_entries(cities: DataFrame) -> DataFrame:
    """Catalog entries `tile_catalog` leaves out, for a warning."""
    return cities.where(F.col("number").isNull() & F.col("numbers").isNull())


def image_name(city: Column, number: Column, digits: int = 0) -> Column:
    """`{city}{number}`, or `{city}_{number}` with leading zeros."""
    if digits:
        return F.format_string(f"%s_%0{digits}d", city, number)
    return F.concat(city, number.cast("string"))


def image_path(fold: Column, city: Column, number: Column, folder: str = "images", extension: str = ".tif") -> Column:
    return F.concat(fold, F.lit(f"/{folder}/"), image_name(city, number), F.lit(extension))


def city_path(city: Column, number: Column, extension: str) -> Column:
    return F.concat(city, F.lit("/"), image_name(city, number, 2), F.lit(extension))


def params_text(params: Column) -> Column:
    """`key_value` pairs of a MAP<STRING, DOUBLE>, sorted by key; whole numbers without decimals."""

    def show(v: Column) -> Column:
        return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))

    entries = F.array_sort(F.map_entries(params))
    return F.concat_ws("_", F.transform(entries, lambda e: F.concat(e["key"], F.lit("_"), show(e["value"]))))


def latest_run(runs: DataFrame, name: str | None = None) -> DataFrame:
    """Newest `path` of each run name, or of the one named."""
    chosen = runs if name is None else runs.where(F.col("run_name") == name)
    return chosen.groupBy("run_name").agg(F.max_by("path", "ts").alias("path"), F.max("ts").alias("ts"))


def newest_run(runs: DataFrame) -> DataFrame:
    """The newest run over all names, one row."""
    newest = F.max(F.struct("ts", "run_name", "path")).alias("r")
    return runs.agg(newest).where(F.col("r").isNotNull()).select("r.run_name", "r.ts", "r.path")


def parse_run_paths(paths: DataFrame) -> DataFrame:
    """Splits `name | timestamp` directory names; the text carries no time zone, so the result has none."""
    parts = F.split("path", r" \| ")
    return paths.select(
        F.element_at(F.split(parts[0], "/"), -1).alias("run_name"), F.to_timestamp_ntz(parts[1]).alias("ts"), "path"
    )


def run_path(name: str) -> Column:
    """Directory of a run started now."""
    return F.concat(F.lit(f"{name} | "), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def oversample(df: DataFrame, repeats: dict[int, int]) -> DataFrame:
    """Repeat the rows of each level an integer number of times; levels not listed are left out."""
    if any(not isinstance(n, int) or n < 0 for n in repeats.values()):
        raise ValueError("repeats must be integers")
    count = F.create_map(*[x for level, n in repeats.items() for x in (F.lit(level), F.lit(n))])
    times = F.coalesce(F.try_element_at(count, F.col("ds_fac")), F.lit(0))
    return df.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def union_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets, tagged with their name."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return union


def pending(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images whose output is still absent."""
    return images.join(done.select("image_id").distinct(), "image_id", "left_anti")


class RoundError(RuntimeError):
    """A stored polygon version that cannot be read: `state` is unfinished or damaged."""

    def __init__(self, state: str, path: str, why: str):
        super().__init__(f"{state} polygon version at {path}: {why}")
        self.state = state


COMMIT = "version BIGINT, data STRING, rows BIGINT, columns STRING"


def _found(spark: SparkSession, path: str, kind: str, schema=None) -> DataFrame | None:
    """The table at a path, None where there is nothing of that name."""
    reader = spark.read.format(kind)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _last_commit(spark: SparkSession, base: str):
    commits = _found(spark, f"{base}/commits/*/", "json", COMMIT)
    return None if commits is None else commits.where("version IS NOT NULL").orderBy(F.desc("version"), F.desc("data")).first()


def save_round(polygons: DataFrame, path: str, source: str) -> int:
    """Store one polygon version as `source` below `path`; gives the number of this writing.

    Rows go to a folder of their own; a commit record (number, folder, rows, columns) is written when they are complete. Until then
    readers see what was committed before, so a rerun replaces a version at once or not at all. Earlier writings stay.
    """
    spark, base = polygons.sparkSession, f"{path.rstrip('/')}/{source}"
    rows = polygons.drop("source")
    last = _last_commit(spark, base)
    version = last.version + 1 if last else 0
    data = f"{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/data/{data}")
    count = spark.read.schema(rows.schema).parquet(f"{base}/data/{data}").count()
    commit = spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(data).alias("data"), F.lit(count).cast("long").alias("rows"), F.lit(rows.schema.json()).alias("columns")
    )
    commit.coalesce(1).write.json(f"{base}/commits/{data}")
    return version


def load_round(spark: SparkSession, path: str, source: str, images: DataFrame | None = None) -> DataFrame | None:
    """Read the last committed writing of a version. With `images`, those without polygons have a null ring.

    None when it was never written. A version whose only writing was not completed, and one whose rows are not those that were
    committed, raise `RoundError`.
    """
    base = f"{path.rstrip('/')}/{source}"
    commit = _last_commit(spark, base)
    if commit is None:
        if _found(spark, base, "binaryFile") is None:
            return None
        raise RoundError("unfinished", base, "no commit record")
    schema = StructType.fromJson(json.loads(commit.columns))
    rows = _found(spark, f"{base}/data/{commit.data}", "parquet", schema)
    if rows is None:
        raise RoundError("damaged", base, "its rows are gone")
    count = rows.count()
    if count != commit.rows:
        raise RoundError("damaged", base, f"{count} rows where {commit.rows} were committed")
    rows = rows.withColumn("source", F.lit(source))
    return rows if images is None else attach_round(images, rows)


def attach_round(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Left join of images with a version; `missing` marks images it does not cover."""
    joined = images.select("image_id").join(rows, "image_id", "left")
    return joined.withColumn("missing", F.col("poly_id").isNull())


def gather_results(spark: SparkSession, path: str, suffix: str = "", prefix: str = "") -> DataFrame:
    """All result files below a folder whose name starts and ends as asked, read as one table."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}*{suffix}")
    return reader.parquet(path).withColumn("file", F.input_file_name())
