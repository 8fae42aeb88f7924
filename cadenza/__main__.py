"""The commands: analyze, rename, export and selftest."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza.operators import collection
from cadenza.plans import library
from cadenza.plans.analysis import analyze, selftest, spectrograms
from cadenza.plans.options import Options
from cadenza.sources import audio

_OWN = ("centre_bpm", "width_octaves")  # set from each track's energy


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cadenza", description="Tempo, key, sections and device libraries of folders of audio files.")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze", help="write a report a track, and its figures")
    one.add_argument("folder")
    one.add_argument("out")
    one.add_argument("--no-figures", action="store_true", help="write reports alone")
    one.add_argument("--plot-start", type=float, default=0.0)
    one.add_argument("--plot-window", type=float, default=30.0)
    two = commands.add_parser("rename", help="say or place the files under names of their tempo and key")
    two.add_argument("folder")
    two.add_argument("--mode", choices=("print", "symlink", "copy"), default="print")
    two.add_argument("--out", help="where symlinks and copies go")
    two.add_argument("--reports", help="also write the reports here")
    for command in (one, two):
        for f in fields(Options):
            if f.name in _OWN:
                continue
            flag = f"--{f.name.replace('_', '-')}"
            if f.default is True:
                command.add_argument(flag, action=argparse.BooleanOptionalAction, default=True)
            else:
                command.add_argument(flag, type=float if f.default is None else type(f.default), default=f.default)
    three = commands.add_parser("export", help="put audio files and their reports on a device")
    three.add_argument("folder")
    three.add_argument("reports")
    three.add_argument("out")
    three.add_argument("--target", choices=("all", "pages", "sql"), default="all")
    three.add_argument("--audio", choices=("none", "copy", "symlink"), default="copy")
    three.add_argument("--trim", action="store_true", help="cut copied WAV files to their first beat")
    three.add_argument("--date", help="YYYY-MM-DD of everything written; else SOURCE_DATE_EPOCH's, else today")
    four = commands.add_parser("selftest", help="measure generated click trains")
    four.add_argument("bpm", nargs="*", type=float, default=[128.0, 150.0, 174.0])
    return out


def export_date(asked: str | None) -> str:
    if asked:
        return datetime.date.fromisoformat(asked).isoformat()
    epoch = os.environ.get("SOURCE_DATE_EPOCH")
    day = datetime.datetime.fromtimestamp(int(epoch), datetime.UTC).date() if epoch else datetime.date.today()
    return day.isoformat()


def options(args: argparse.Namespace) -> Options:
    return Options(**{f.name: getattr(args, f.name) for f in fields(Options) if f.name not in _OWN})


def reports_of(spark: SparkSession, folder: str, o: Options):
    read = audio.read_audio(spark, folder)
    if o.start_seconds or o.duration_seconds is not None:
        read = audio.excerpt(read, o.start_seconds, o.duration_seconds)
    return read, analyze(read, o)


def _named(df, ending: str):
    name = F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1)
    return F.concat(collection.stem(name), F.lit(ending))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "selftest":
        rows = selftest(spark, args.bpm).collect()
        for r in rows:
            print(f"{r.wanted:g} BPM: measured {r.bpm_measured:.3f}, {'passed' if r.passed else 'FAILED'}")
        return 0 if all(r.passed for r in rows) else 1
    if args.command == "export":
        skipped = library.export(spark, args.folder, args.reports, args.out, export_date(args.date), args.target, args.audio, args.trim).collect()
        for r in skipped:
            print(f"skipped {r.file_name}: {r.reason}", file=sys.stderr)
        return 0
    o = options(args)
    tracks, reports = reports_of(spark, args.folder, o)
    folder = args.out if args.command == "analyze" else args.reports
    if folder:
        made = library.report_json(reports)
        library.write_files(made.withColumn("path", _named(made, ".json")), folder, data="json").count()
    if args.command == "rename":
        for r in library.rename_plan(reports).where("target is null").collect():
            print(f"{r.path}: {r.reason}", file=sys.stderr)
        for path, target in library.rename_files(library.rename_plan(reports), args.out or ".", args.mode):
            print(f"{path} -> {target}")
        return 0
    if not args.no_figures:
        drawn = library.report_figures(reports, spectrograms(tracks, o), args.plot_start, args.plot_window)
        library.write_files(drawn.withColumn("path", F.concat(_named(drawn, "/"), "file")), args.out).count()
    failed = 0
    for r in library.report_summaries(reports).orderBy("path").toLocalIterator():
        print(f"{r.path}\n{r.summary}", end="")
    failed = reports.where("error is not null").count()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
