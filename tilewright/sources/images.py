"""Image files to tile features, a row per image, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.matching import ContractError
from ..shipping import ship

#: What is read as an image, and the sides, channels and measures of tiles.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
TILE_SIDES = (32, 64, 128, 256)
CHANNELS = ("B", "G", "R")
MEASURES = ("range", "variance", "std", "mad", "Q1", "Q3", "IQR", "cv")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(_extension(F.col("path")).isin(*(e.lower() for e in extensions)))


def list_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length) of the files below root whose extension matches in any case, sorted by path. No file is opened."""
    return _files(spark, root, extensions).select("path", "length").orderBy("path")


def file_hashes(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, sha256), in no order: contents stay in the task that reads them."""
    return _files(spark, root, extensions).select("path", F.sha2("content", 256).alias("sha256"))


def read_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, height, width, channels, data): 8-bit B, G, R rows of the files whose extension matches. One that can't be decoded has height -1."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "data")
    return rows.where(_extension(F.col("path")).isin(*(e.lower() for e in extensions)))


def tile_names(n_tiles: int) -> list[str]:
    return [x for t in range(1, n_tiles + 1) for x in (f"Cronbach_{t}", *(f"{c}{m}_{t}" for c in CHANNELS for m in MEASURES))]


def tile_features(pixels: np.ndarray, side: int) -> np.ndarray:
    """pixels height x width x 3 -> the 25 features of each tile, tiles row by row; NaN where undefined."""
    h, w, _ = pixels.shape
    if h % side or w % side:
        raise ContractError(f"{h} x {w} pixels don't divide into tiles of {side}")
    t = pixels.astype(np.float64).reshape(h // side, side, w // side, side, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, side * side)
    n = t.shape[2]
    mean = t.mean(axis=2)
    q1, q3 = np.percentile(t, [25, 75], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = ((t - mean[..., None]) ** 2).sum(axis=2) / (n - 1)
        std = np.sqrt(var)
        cv = np.where(mean == 0, np.nan, std / mean)
        total = t.sum(axis=1)
        tv = ((total - total.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) / (n - 1)
        alpha = np.where(tv == 0, np.nan, 1.5 * (1 - var.sum(axis=1) / tv))
    cells = np.stack([np.ptp(t, axis=2), var, std, np.abs(t - mean[..., None]).mean(axis=2), q1, q3, q3 - q1, cv], axis=2)
    if n < 2:
        cells[:] = np.nan
    return np.concatenate([alpha[:, None], cells.reshape(len(t), -1)], axis=1)


def extract(spark: SparkSession, root: str, side: int, label: int | None = None, class_name: str | None = None) -> DataFrame:
    """A row per image: file_name, path, width, height, tile_side, class_name, label, source_group (its stem, until a group is attached), features array<double> in tile_names order, and issue (null if fine).

    An image that can't be read, has other than 1, 3 or 4 channels or doesn't
    divide into tiles has an issue and no features. Grey is taken three times,
    an alpha channel is dropped.
    """
    if side not in TILE_SIDES:
        raise ContractError(f"the side of a tile is one of {TILE_SIDES}")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, issues = [], []
            for i in range(batch.num_rows):
                h, w, c = (batch.column(j)[i].as_py() for j in (1, 2, 3))
                if h <= 0 or c not in (1, 3, 4):
                    found.append(None)
                    issues.append("unreadable image" if h <= 0 else f"{c} channels")
                    continue
                x = np.frombuffer(batch.column(4)[i].as_py(), np.uint8).reshape(h, w, c)
                try:
                    f = tile_features(np.repeat(x, 3, axis=2) if c == 1 else x[..., :3], side)
                    found.append([None if np.isnan(v) else float(v) for v in f.reshape(-1)])
                    issues.append(None)
                except ContractError as e:
                    found.append(None)
                    issues.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64())), pa.array(issues, pa.string())], names=["path", "height", "width", "features", "issue"])

    rows = read_images(spark, root).mapInArrow(run, "path string, height int, width int, features array<double>, issue string")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("file_name"), "path", "width", "height", F.lit(side).alias("tile_side"), F.lit(class_name).cast("string").alias("class_name"), F.lit(label).cast("int").alias("label"), K.stem(F.col("path")).alias("source_group"), "features", "issue")
