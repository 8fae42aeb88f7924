"""Reports as files, the collection that they make up, and what players read of it."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.exports import analysis_files, device, engine, figures, settings
from cadenza.operators import collection, naming
from cadenza.sources import audio, mp3

_WAVE = "struct<columns_per_second:double,columns:string>"
# What the exports read of a report; older ones may lack the nullable parts.
NARROW = f"""source struct<sample_rate:int,channels:int,duration_seconds:double,analysed_start_seconds:double,trim_to_first_beat_seconds:double>,
 tempo struct<bpm:double,grid:struct<beats_seconds:array<double>>,bar:struct<phase:int,beats_per_bar:int>>, key struct<name:string,camelot:string>,
 structure struct<sections:array<struct<label:string,start_seconds:double,end_seconds:double>>,cues:array<struct<kind:string,number:int,name:string,time_seconds:double>>>,
 waveforms struct<preview:{_WAVE},detail:{_WAVE}>, _corrupt string""".replace("\n ", " ")
FILES = "path string, bytes binary, write_order long"


def report_json(reports: DataFrame, pretty: bool = True) -> DataFrame:
    """(path, json) of the reports of analyze that have no error: packed waveforms in base64, curves left out."""
    wave = lambda name: F.struct(F.col(f"waveforms.{name}.columns_per_second").alias("columns_per_second"), F.base64(f"waveforms.{name}.columns").alias("columns")).alias(name)
    tempo = F.col("tempo").dropFields("curve", "fourier_bpm")
    whole = F.struct("tool", "version", "source", "settings", tempo.alias("tempo"), "key", "bands", "energy", "spectrum", "structure", F.struct(wave("preview"), wave("detail")).alias("waveforms"), F.col("findings").alias("diagnostics"))
    return reports.where("error is null").select("path", F.to_json(whole, {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def report_figures(reports: DataFrame, spectrograms: DataFrame | None = None, start: float = 0.0, window: float = 30.0) -> DataFrame:
    """(path, file, bytes): every figure of every track without an error, its page last; pictures of the tracks in
    spectrograms. One track is drawn at a time."""
    rows = reports.where("error is null")
    rows = rows.withColumn("spectrogram", F.lit(None).cast("string")) if spectrograms is None else rows.join(spectrograms.select("path", F.struct(*[c for c in spectrograms.columns if c != "path"]).alias("spectrogram")), "path", "left")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = figures.figures(row, row.pop("spectrogram"), start, window)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(made)), pa.array(list(made)), pa.array(list(made.values()), pa.binary())], names=["path", "file", "bytes"])

    needed = ["path", "source", "settings", "tempo", "key", "bands", "spectrum", "findings", "average_spectrum", "novelty", "spectrogram"]
    return rows.select(*needed).mapInArrow(drawn, "path string, file string, bytes binary")


def report_summaries(reports: DataFrame) -> DataFrame:
    """(path, summary): a few lines a track."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([figures.summary(r) for r in rows])], names=["path", "summary"])

    return reports.select("path", "source", "tempo", "key", "structure", "findings", "error").mapInArrow(told, "path string, summary string")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_path, stem, error, and the columns of NARROW) of the folder's .json files, one report a file. A file of
    another shape has its reason in error."""
    options = {"multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "pathGlobFilter": "*.json"}
    rows = spark.read.schema(NARROW).options(**options).json(folder).select("*", F.col("_metadata.file_path").alias("report_path"), F.col("_metadata.file_name").alias("file_"))
    whole = F.col("source.sample_rate").isNotNull() & F.col("tempo.bpm").isNotNull() & F.col("tempo.grid.beats_seconds").isNotNull() & F.col("key.camelot").isNotNull() & F.col("waveforms.preview.columns").isNotNull()
    error = F.when(F.col("_corrupt").isNotNull() | ~whole, "the report is not of the shape that exports read")
    return rows.select("report_path", collection.stem(F.url_decode(F.replace("file_", F.lit("+"), F.lit("%2B")))).alias("stem"), error.alias("error"), "source", "tempo", "key", "structure", "waveforms")


def paired(files: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): audio files (path, file_name, length) with the report of their name's stem, and files without
    one, of a format that isn't exported, or whose report has an error, with the reason."""
    named = files.withColumn("stem", collection.stem(F.col("file_name"))).withColumn("format", collection.file_format(F.col("file_name")))
    both = named.join(reports.withColumnRenamed("error", "report_error"), "stem", "left")
    reason = F.when(F.col("report_path").isNull(), "no report").when(F.col("format").isNull(), "no exportable format").otherwise(F.col("report_error"))
    both = both.withColumn("reason", reason)
    return both.where("reason is null").drop("reason", "report_error"), both.where("reason is not null").select("path", "file_name", "reason")


def library(pairs: DataFrame, folder: str = "/Contents", to_first_beat: bool = False) -> DataFrame:
    """The collection's tracks from pairs, by file name: names, numbers, beats, cues, sections and waveforms, all times
    shifted as the file is placed, and `position` from 0. Every column is an expression over the report's."""
    began, cut = collection.time_shift(F.col("source.analysed_start_seconds"), F.col("source.trim_to_first_beat_seconds"), to_first_beat)
    rows = pairs.withColumn("shift_", began).withColumn("trim_seconds", cut)
    names = collection.artist_title(F.col("file_name"))
    kbps = naming.bitrate(F.col("format"), F.col("source.sample_rate"), F.greatest(F.col("source.channels"), F.lit(1)), F.col("length"), F.col("source.duration_seconds"))
    rows = rows.withColumn("beats", collection.beats(F.col("tempo.grid.beats_seconds"), F.col("tempo.bpm"), F.col("tempo.bar.phase"), F.col("tempo.bar.beats_per_bar"), F.col("shift_")))
    rows = rows.select(
        F.col("path").alias("source_path"), "file_name", F.concat(F.lit(folder.rstrip("/") + "/"), "file_name").alias("device_path"), names["artist"].alias("artist"), names["title"].alias("title"),
        F.lit(None).cast("string").alias("album"), F.lit(None).cast("string").alias("genre"), F.lit("").alias("comment"), F.col("tempo.bpm").alias("bpm"), F.col("key.name").alias("key_name"), F.col("key.camelot").alias("key_camelot"),
        F.col("source.duration_seconds").alias("duration_seconds"), F.col("source.sample_rate").alias("sample_rate"), F.lit(16).alias("bit_depth"), kbps.alias("bitrate_kbps"), F.col("length").cast("long").alias("file_size"), "format", "trim_seconds",
        "beats", collection.cues(F.col("structure.cues"), F.col("beats"), F.col("shift_")).alias("cues"), collection.sections(F.col("structure.sections"), F.col("shift_")).alias("sections"),
        F.unbase64("waveforms.preview.columns").alias("preview"), F.unbase64("waveforms.detail.columns").alias("detail"),
    )
    rows = collection.keep_first(rows, "file_name", "source_path")
    return numbered(rows, "file_name")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `position`, its rows' places from 0 by a column of distinct values."""
    codes = naming.dictionary(df, order, order).withColumnRenamed("code", "position")
    return df.join(codes, order)


def place_audio(tracks: DataFrame, root: str, mode: str = "copy", to_first_beat: bool = False) -> DataFrame:
    """tracks with their files placed below root, and duration and size as written; mode is none, copy or symlink.

    Only a copied WAV file can be cut to its first beat: asking for that with symlinks is an error, and files of other
    formats stay whole with their times. root is a folder that all executors can write, such as a mounted stick. Files
    are copied where their track's task runs, each through a new name, so a task that runs again does no harm.
    """
    if mode not in ("none", "copy", "symlink"):
        raise ValueError(f"no such mode: {mode}")
    if to_first_beat and mode != "copy":
        raise ValueError("only copied files can be cut")
    if mode == "none":
        return tracks
    at = {name: i for i, name in enumerate(tracks.columns)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                t = {c: one.column(at[c])[0].as_py() for c in ("source_path", "device_path", "format", "trim_seconds", "duration_seconds", "file_size")}
                source, target = _local(t["source_path"]), os.path.join(root, t["device_path"].lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                fresh = f"{target}.{os.getpid()}.part"
                seconds, size = t["duration_seconds"], t["file_size"]
                if mode == "symlink":
                    os.symlink(os.path.abspath(source), fresh)
                elif to_first_beat and t["format"] == "wav" and t["trim_seconds"] > 0:
                    with open(source, "rb") as file:
                        cut = audio.trim_wav(file.read(), t["trim_seconds"])
                    with open(fresh, "wb") as file:
                        file.write(cut)
                    seconds, size = seconds - t["trim_seconds"], len(cut)
                else:
                    shutil.copyfile(source, fresh)
                os.replace(fresh, target)
                columns = list(one.columns)
                columns[at["duration_seconds"]], columns[at["file_size"]] = pa.array([seconds], pa.float64()), pa.array([size], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=one.schema.names)

    return tracks.mapInArrow(placed, tracks.schema)


def _local(path: str) -> str:
    from urllib.parse import unquote, urlparse

    return unquote(urlparse(path).path) if path.startswith("file:") else path


def device_names(tracks: DataFrame) -> dict[str, list[str]]:
    """The artists, genres, albums and keys of a device's tracks, each as it first appears: what one device lists."""
    columns = {"artist": "artist", "genre": "genre", "album": "album", "key": "key_camelot"}
    light = tracks.select("position", *columns.values())
    return {kind: [r[0] for r in light.where(F.col(c) != "").groupBy(c).agg(F.min("position").alias("first")).orderBy("first").collect()] for kind, c in columns.items()}


def with_device_fields(tracks: DataFrame, names: dict[str, list[str]], date: str) -> DataFrame:
    """tracks with the ids of their names, from 1 and 0 for none, rounded numbers and the paths of their analysis files."""
    rows = tracks.withColumn("key", F.col("key_camelot"))
    for kind, own in names.items():
        ids = tracks.sparkSession.createDataFrame([(name, i) for i, name in enumerate(own, 1)], f"{kind} string, {kind}_id int")
        rows = rows.join(F.broadcast(ids), kind, "left").withColumn(f"{kind}_id", F.coalesce(f"{kind}_id", F.lit(0)))
    return rows.withColumns({
        "id": F.col("position") + 1, "centi_bpm": collection.centi_bpm(F.col("bpm")), "duration_rounded": collection.duration_rounded(F.col("duration_seconds")),
        "analyze_path": F.concat(naming.analysis_folder(F.col("device_path")), F.lit("/ANLZ0000.DAT")), "date": F.lit(date),
    })


def with_seek_tables(tracks: DataFrame) -> DataFrame:
    """tracks with the `seek_table` of their MP3 files, null for other formats."""
    files = tracks.sparkSession.read.format("binaryFile")
    paths = [r[0] for r in tracks.where("format = 'mp3'").select("source_path").collect()]  # names alone, one a track of the device
    if not paths:
        return tracks.withColumn("seek_table", F.lit(None).cast("array<bigint>"))
    found = mp3.with_seek_tables(files.load([_local(p) for p in paths]).select(F.col("path").alias("source_path"), "content")).drop("content")
    return tracks.join(found, "source_path", "left")


def device_files(tracks: DataFrame, date: str, playlists: list[tuple[str, list[int]]] | None = None, target: str = "all", **choices: str) -> DataFrame:
    """(path, bytes, write_order): the files that players read, analysis files first, then databases and settings.

    playlists are names and track ids from 1; without any there is one of all tracks. target is `all`, `pages` (the paged
    database and its analysis files) or `sql`. Analysis files are made in their tracks' tasks. A database is one file
    with all tracks in their order, so one task writes it; it can't hold more than a device does, which is 2^32 rows.
    choices are settings (see exports.settings).
    """
    if target not in ("all", "pages", "sql"):
        raise ValueError(f"no such target: {target}")
    spark, names = tracks.sparkSession, device_names(tracks)
    rows = with_device_fields(with_seek_tables(tracks), names, date)
    out = []
    if target != "sql":
        out.append(rows.mapInArrow(_analysis, FILES))
    out.append(rows.repartition(1).sortWithinPartitions("position").mapInArrow(_databases(names, playlists, date, target), FILES))
    if target != "sql":
        fixed = [(path, bytearray(data), (1 << 40) + 2 + i) for i, (path, data) in enumerate(settings.files(**choices).items())]
        out.append(spark.createDataFrame(fixed, FILES))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _file_rows(found: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
    paths, data, order = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary()), pa.array(order, pa.int64())], names=["path", "bytes", "write_order"])


def _analysis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            t = batch.slice(i, 1).to_pylist()[0]
            folder = t["analyze_path"].rsplit("/", 1)[0].lstrip("/")
            made = (("DAT", analysis_files.dat(t)), ("EXT", analysis_files.ext(t)), ("2EX", analysis_files.two_ex(t)))
            yield _file_rows([(f"{folder}/ANLZ0000.{kind}", data, 3 * t["position"] + n) for n, (kind, data) in enumerate(made)])


def _databases(names: dict[str, list[str]], playlists: list[tuple[str, list[int]]] | None, date: str, target: str) -> Callable:
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracks = [t for batch in batches for t in batch.drop_columns(["detail"]).to_pylist()]
        if not tracks and not names["artist"]:
            lists = playlists or []
        else:
            lists = [("All tracks", [t["id"] for t in tracks])] if playlists is None else playlists
        found = []
        if target != "sql":
            found.append((device.PATH, device.library(tracks, names, lists), 1 << 40))
        if target != "pages":
            found.append((engine.PATH, engine.build(tracks, lists, date), (1 << 40) + 1))
        yield _file_rows(found)

    return built


def write_files(files: DataFrame, root: str, path: str = "path", data: str = "bytes") -> DataFrame:
    """Writes every row's bytes below root, a folder that all executors can write, and returns (path, size) of each."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(root, name.lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}.part", "wb") as file:
                    file.write(content)
                os.replace(f"{target}.{os.getpid()}.part", target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    schema = T.StructType().add("path", "string").add("size", "long")
    return files.select(F.col(path).cast("string").alias("path"), F.col(data).cast("binary").alias("bytes")).mapInArrow(written, schema)


def rename_plan(reports: DataFrame) -> DataFrame:
    """(path, target, reason, findings): what each file would be called, null where its tempo or key gives no name."""
    name = F.element_at(F.split("path", "/"), -1)
    target = naming.target_name(F.col("tempo.bpm"), F.col("key.camelot"), name)
    reason = F.coalesce(F.col("error"), F.when(F.col("target").isNull(), "no name for its tempo and key"))
    return reports.withColumn("target", target).select("path", "target", reason.alias("reason"), "findings")


def rename_files(plan: DataFrame, root: str, mode: str = "print") -> list[tuple[str, str]]:
    """(path, target) of the plan's files; with symlink or copy they are placed below root under their new names."""
    if mode not in ("print", "symlink", "copy"):
        raise ValueError(f"no such mode: {mode}")
    pairs = [(r.path, r.target) for r in plan.where("target is not null").select("path", "target").orderBy("path").collect()]  # names alone
    for path, target in pairs if mode != "print" else []:
        os.makedirs(root, exist_ok=True)
        out = os.path.join(root, target)
        (os.symlink if mode == "symlink" else shutil.copyfile)(os.path.abspath(_local(path)), out)
    return pairs


def export(spark: SparkSession, audio_folder: str, report_folder: str, root: str, date: str, target: str = "all", mode: str = "copy", to_first_beat: bool = False, **choices: str) -> DataFrame:
    """Puts a folder of audio files and their reports on a device: places the files, then writes what players read of
    them. Returns the skipped files with the reasons."""
    files = audio.audio_files(spark, audio_folder, ("wav", "flac", "mp3", "aiff", "aif"), contents=False)
    pairs, skipped = paired(files, read_reports(spark, report_folder))
    tracks = place_audio(library(pairs, to_first_beat=to_first_beat), root, mode, to_first_beat).persist()
    tracks.count()  # files lie in place, with their sizes known, before any database says so
    write_files(device_files(tracks, date, target=target, **choices), root).collect()
    return skipped


def shown(column: Column) -> Column:
    """A report's NaN as null, as JSON has it."""
    return F.nanvl(column, F.lit(None))
