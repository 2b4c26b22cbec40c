"""The whole development of an image as ordered transforms, and the batch entry point."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.functions.spaces import resolve
from pixelmill.operators import geometry, metering
from pixelmill.operators import pixels as P
from pixelmill.operators.lut import Lut1D, Lut3D, apply_lut
from pixelmill.sources import cube, images, sinks
from pixelmill.streaming import events

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Params:
    """Checked when made: unknown names fail before any work."""

    log_space: str
    exposure: float | None = None
    metering: str = "hybrid"
    lut: Lut1D | Lut3D | None = None
    lens: dict | None = None

    def __post_init__(self):
        resolve(self.log_space)
        if self.exposure is None and self.metering not in metering.STRATEGIES:
            raise ValueError(f"unknown metering mode {self.metering!r}")


def develop(px: DataFrame, params: Params, sizes: DataFrame | None = None, matched: DataFrame | None = None) -> DataFrame:
    """Exposure, lens, boost, gamut, log curve, LUT. A manual exposure of 0 counts as manual.

    ``matched`` has each image's own calibration; ``params.lens`` is one for all images, with optional toggles distortion, tca, vignetting.
    """
    _, gamut, curve = resolve(params.log_space)
    px = P.manual_exposure(px, params.exposure) if params.exposure is not None else metering.auto_expose(px, params.metering, sizes)
    px = px.select("image_id", "y", "x", "r", "g", "b")
    given = dict(params.lens or {})
    toggles = {t: given.pop(t) for t in ("distortion", "tca", "vignetting") if t in given}
    if matched is None and given:
        sizes = P.dims(px) if sizes is None else sizes
        every = {k: 1.0 if k in ("kr", "kb") else 0.0 for k in ("k1", "k2", "k3", "a", "b", "c", "kr", "kb")} | given
        matched = sizes.select("image_id", F.lit("matched").alias("lens_status"), *[F.lit(float(v)).alias(k) for k, v in every.items()])
    if matched is not None:
        px = geometry.correct_lenses(px, matched, P.dims(px) if sizes is None else sizes, **toggles)
    return px.transform(P.boost).transform(P.to_gamut, gamut).transform(P.log_encode, curve).transform(apply_lut, params.lut)


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``; a path without a scheme is on the default file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def process_path(
    spark: SparkSession, input_path: str, output_path: str, log_space: str, lut_path: str | None = None, exposure: float | None = None, lens: dict | None = None,
    metering_mode: str = "hybrid", output_format: str = "tif", on_lut_error: str = "skip", suffixes=images.EXTENSIONS, lenses: DataFrame | None = None,
) -> DataFrame:
    """Develop a folder or a file and write one image each; returns image_id, out, bytes, error, lens_status.

    A folder's images go to the folder ``output_path``. A single file's image goes to
    the file ``output_path``, whose suffix then names the format, unless that is a
    folder. Each file is decoded once, into a table of tiles that is deleted at the
    end; the report is a table beside it, kept. A file that can't be decoded,
    developed or written is reported in ``error`` and doesn't stop the others. Two
    inputs that would write one name are an error; a LUT that can't be read is logged
    and left out (``on_lut_error="skip"``) or fails. ``lenses`` (lens_db.SCHEMA) turns
    lens correction by each file's own lens data on; lens_status says what came of it.
    """
    lut = None
    if lut_path:
        try:
            lut = cube.read(spark, lut_path)
        except Exception as e:
            if on_lut_error != "skip":
                raise
            log.warning("LUT %s left out: %s", lut_path, e)
    params = Params(log_space, exposure, metering_mode, lut, lens)
    files = images.scan(spark, input_path, suffixes)
    single = None
    if not _is_folder(spark, input_path) and not _is_folder(spark, output_path):
        output_path, _, single = output_path.rpartition("/")
        output_path, output_format = output_path or ".", single.rpartition(".")[2].lower() if "." in single else output_format
    out = F.lit(single) if single else sinks.output_name("path", output_format)
    names = files.select(F.xxhash64("path").alias("image_id"), out.alias("out"))
    clash = sinks.collisions(names).select("out").take(5)
    if clash:
        raise ValueError("several inputs would write " + ", ".join(r["out"] for r in clash))
    work = f"{spark.conf.get('spark.checkpoint.dir', None) or output_path}/.pixelmill-{uuid.uuid4().hex}"
    images.decode_tiles(files).write.parquet(f"{work}/tiles")
    tiles = spark.read.schema(images.TILE_SCHEMA).parquet(f"{work}/tiles")
    known = images.image_table(tiles)
    sizes = known.filter("error is null").select("image_id", "h", "w")
    matched = None if lenses is None else geometry.match_lens(known.filter("error is null").select("image_id", *images.EXIF), lenses)
    done = sinks.write_images(develop(images.tiles_to_pixels(tiles), params, sizes, matched), names, output_path, output_format)
    failed = known.filter("error is not null").join(names, "image_id").select("image_id", "out", F.lit(0).cast("long").alias("bytes"), "error")
    report = done.unionByName(failed)
    status = known.select("image_id", F.lit("off").alias("lens_status")) if matched is None else matched.select("image_id", "lens_status")
    report.join(status, "image_id", "left").write.parquet(f"{work}/report")
    fs, target = _filesystem(spark, f"{work}/tiles")
    fs.delete(target, True)
    return spark.read.schema("image_id long, out string, bytes long, error string, lens_status string").parquet(f"{work}/report")


def messages(report: DataFrame) -> DataFrame:
    """The messages of a batch (streaming.events.MESSAGE): the number of files, then one a file, failed or not, in order of its name."""
    n = report.count()
    head = report.sparkSession.createDataFrame([(0, None, f"found {n} files", "info", n, None)], events.MESSAGE)
    order = F.row_number().over(Window.orderBy("out", "image_id")).cast("long")
    each = report.select(
        order.alias("seq"), F.col("out").alias("id"), F.coalesce(F.concat(F.lit("failed: "), "error"), F.concat(F.lit("written, lens "), "lens_status")).alias("msg"),
        F.when(F.col("error").isNotNull(), "error").otherwise("info").alias("level"), F.lit(None).cast("int").alias("total_files"), F.lit("done").alias("status"),
    )
    return head.unionByName(each)
