"""The hook for a user's model: patches in, displacement and segmentation cells out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.operators.raster import cells_in_patches
from ringfield.operators.skew import shuffled
from ringfield.operators.tiles import patch_grid
from ringfield.operators.windows import stitch_patches

# Network geometry of the published configuration.
INPUT_RES = 220
OUTPUT_RES = 100
LAYERS = ("fill", "edge", "vertex")
SEG_LAYERS = ("bg", "fill", "edge", "vertex")

# images [n, res, res, bands] in [-1, 1] and maps [n, res, res, 3] in [0, 1] to
# displacement [n, out, out, 2] in [-0.5, 0.5] and segmentation [n, out, out, 4].
ModelFn = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def zero_model(images: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicts no displacement and echoes the input map; for tests."""
    n, res = maps.shape[:2]
    margin = (res - OUTPUT_RES) // 2 if res > OUTPUT_RES else 0
    inner = maps[:, margin : res - margin, margin : res - margin, :]
    background = np.prod(1 - inner, axis=-1, keepdims=True)
    return np.zeros((n, inner.shape[1], inner.shape[2], 2)), np.concatenate([background, inner], axis=-1)


def constant_model(di: float, dj: float) -> ModelFn:
    """Predicts the same normalised vector everywhere; for tests."""

    def model(images: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        field, seg = zero_model(images, maps)
        field[..., 0], field[..., 1] = di, dj
        return field, seg

    return model


def predict_patches(
    pixels: DataFrame,
    cells: DataFrame,
    images: DataFrame,
    model_fn: ModelFn,
    input_res: int = INPUT_RES,
    output_res: int = OUTPUT_RES,
    bands: int = 3,
    batch_size: int = 12,
    max_abs: float = 4.0,
    dynamic_range: float = 0.5,
) -> DataFrame:
    """Cells of the inner image: (image_id, i, j, di, dj, bg, fill, edge, vertex).

    One row per patch carries its pixels and raster cells (a patch is small and
    of fixed size); the model sees batches of them inside the executors. Images
    smaller than a patch are left out. Where patches overlap the later wins.
    """
    usable = images.where((F.col("height") >= input_res) & (F.col("width") >= input_res))
    patches = patch_grid(usable, output_res, input_res)
    values = pixels.where(F.col("band") < bands).select("image_id", F.col("band").alias("channel"), "i", "j", "value")
    layer_channel = F.create_map(*[x for n, name in enumerate(LAYERS) for x in (F.lit(name), F.lit(bands + n))])
    drawn = cells.where(F.col("layer").isin(*LAYERS)).select(
        "image_id", layer_channel[F.col("layer")].alias("channel"), "i", "j", "value"
    )
    placed = cells_in_patches(values.unionByName(drawn), patches)
    index = (F.col("channel") * input_res + F.col("pi")) * input_res + F.col("pj")
    packed = placed.select("image_id", "patch_id", F.struct(index.alias("at"), F.col("value").alias("v")).alias("c"))
    packed = packed.groupBy("image_id", "patch_id").agg(F.collect_list("c").alias("c"))
    rows = packed.join(shuffled(patches.select("image_id", "patch_id", "r0", "c0")), ["image_id", "patch_id"]).select(
        "image_id", "patch_id", "r0", "c0", F.transform("c", lambda c: c["at"]).alias("at"), F.transform("c", lambda c: c["v"]).alias("v")
    )
    channels = bands + len(LAYERS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first in range(0, len(part), batch_size):
                yield _predict(part.iloc[first : first + batch_size])

    def _predict(batch: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((batch_size, channels * input_res * input_res))
        for n, (at, v) in enumerate(zip(batch["at"], batch["v"])):
            full[n, np.asarray(at)] = v
        full[len(batch) :] = full[len(batch) - 1]
        full = full.reshape(batch_size, channels, input_res, input_res).transpose(0, 2, 3, 1) / 255.0
        field, seg = model_fn(full[..., :bands] * 2.0 - 1.0, full[..., bands:])
        count, side = len(batch), field.shape[1]
        y, x = np.meshgrid(np.arange(side), np.arange(side), indexing="ij")
        frame = {
            "image_id": np.repeat(batch["image_id"].to_numpy(), side * side),
            "patch_id": np.repeat(batch["patch_id"].to_numpy(), side * side),
            "i": (batch["r0"].to_numpy()[:, None] + y.ravel()).ravel(),
            "j": (batch["c0"].to_numpy()[:, None] + x.ravel()).ravel(),
        }
        scaled = field[:count] / dynamic_range * max_abs
        frame |= {name: scaled[..., n].ravel() for n, name in enumerate(("di", "dj"))}
        frame |= {name: seg[:count, ..., n].ravel() for n, name in enumerate(SEG_LAYERS)}
        return pd.DataFrame(frame)

    columns = ", ".join(f"{n} double" for n in ("di", "dj", *SEG_LAYERS))
    out = rows.mapInPandas(run, f"image_id long, patch_id int, i int, j int, {columns}")
    names = ["di", "dj", *SEG_LAYERS]
    stitched = stitch_patches(out.withColumn("value", F.struct(*names)))
    return stitched.select("image_id", "i", "j", "value.*")


def predicted_cells(prediction: DataFrame, margin: int = (INPUT_RES - OUTPUT_RES) // 2) -> DataFrame:
    """Segmentation of the prediction as cells of the full image, background left out."""
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("value")) for n in LAYERS]))
    return prediction.select(
        "image_id", (F.col("i") + margin).alias("i"), (F.col("j") + margin).alias("j"), layers.alias("c")
    ).select("image_id", "i", "j", "c.layer", "c.value")
