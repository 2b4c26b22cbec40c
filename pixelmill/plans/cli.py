"""Command line: develop a file or a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from pixelmill.functions.spaces import LOG_SPACES, resolve
from pixelmill.operators.metering import STRATEGIES
from pixelmill.plans.develop import messages, process_path
from pixelmill.sources import lens_db


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixelmill", description="Develop images into a log colour space.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--log-space", required=True, type=lambda v: resolve(v)[0], choices=list(LOG_SPACES))
    p.add_argument("--lut")
    p.add_argument("--exposure", type=float)
    p.add_argument("--metering", default="hybrid", choices=list(STRATEGIES))
    p.add_argument("--jobs", type=int, default=4)
    p.add_argument("--format", default="tif", choices=["tif", "heif", "jpg"])
    p.add_argument("--lens-correct", action=argparse.BooleanOptionalAction, default=True, help="correct each image by its own lens data")
    p.add_argument("--lens-db", help="XML file of lens calibrations")
    p.add_argument("--custom-lensfun-db", help="XML file of further calibrations")
    return p


def lenses(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The calibrations that the options name; none where correction is off or no file is named."""
    paths = [p for p in (a.lens_db, a.custom_lensfun_db) if p] if a.lens_correct else []
    loaded = [lens_db.read_xml(spark, p) for p in paths]
    return lens_db.with_custom(loaded[0], loaded[1] if len(loaded) > 1 else None) if loaded else None


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.master(f"local[{a.jobs}]").appName("pixelmill").getOrCreate()
    report = process_path(spark, a.input, a.output, a.log_space, a.lut, a.exposure, metering_mode=a.metering, output_format=a.format, lenses=lenses(spark, a))
    for m in messages(report).orderBy("seq").toLocalIterator():
        print(f"[{m.id}] {m.msg}" if m.id else m.msg)
    return int(not report.filter("error is not null").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
