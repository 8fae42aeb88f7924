"""A collection of tracks from reports: names, formats, beats, cues, playlists, and what a written set of files holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .naming import strip_prefix

# Formats by extension, and the labels that a section may have.
FORMATS = {"wav": "wav", "flac": "flac", "mp3": "mp3", "aiff": "aiff", "aif": "aiff"}
LABELS = ("intro", "build", "drop", "breakdown", "outro", "steady")
_CUE = "array<struct<kind:string,number:int,comment:string,time_seconds:double>>"


def extension(name: Column) -> Column:
    """What stands behind a name's last dot, '' without one."""
    return F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def file_format(name: Column) -> Column:
    """wav, flac, mp3 or aiff by a file's extension in any case, null for others."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(known, F.lower(extension(name)))


def lossless(fmt: Column) -> Column:
    return fmt != "mp3"


def needs_seek_index(fmt: Column) -> Column:
    return fmt == "mp3"


def artist_title(name: Column) -> Column:
    """struct<artist, title> of a file's name: without extension and prefix, underscores as spaces, parted at the first
    ` - ` if there is one, else at the first hyphen; a leading part of digits alone is passed over."""
    spaced = F.replace(strip_prefix(stem(name)), F.lit("_"), F.lit(" "))
    mark = F.when(F.contains(spaced, F.lit(" - ")), " - ").otherwise("-")

    def parted(text: Column) -> Column:
        at = F.call_function("instr", text, mark)
        return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("head"), F.when(at > 0, F.substring(text, at + F.length(mark), F.length(text))).alias("rest"))

    first = parted(spaced)
    body = F.when(F.trim(first["head"]).rlike("^[0-9]+$"), first["rest"]).otherwise(spaced)
    two = parted(body)
    return F.struct(F.coalesce(F.trim(two["head"]), F.lit("")).alias("artist"), F.trim(F.coalesce(two["rest"], body)).alias("title"))


def time_shift(start: Column, trim: Column, to_first_beat: bool) -> tuple[Column, Column]:
    """(seconds to add to all times, seconds cut off the file): times count from the file's start, or from the first
    beat if the file is cut there."""
    start, trim = F.coalesce(start, F.lit(0.0)), F.coalesce(trim, F.lit(0.0))
    return (start - trim, trim) if to_first_beat else (start, F.lit(0.0))


def number_in_bar(index: Column, phase: Column, beats_per_bar: Column) -> Column:
    """1 for a bar's first beat, and so on."""
    each = F.greatest(beats_per_bar, F.lit(1))
    return F.pmod(index - phase % each, each) + 1


def beats(times: Column, bpm: Column, phase: Column, beats_per_bar: Column, shift: Column) -> Column:
    """A grid's beats as an array of struct<time_seconds, bpm, number_in_bar>."""
    return F.transform(times, lambda t, i: F.struct((t + shift).alias("time_seconds"), bpm.alias("bpm"), number_in_bar(i, phase, beats_per_bar).cast("int").alias("number_in_bar")))


def cues(found: Column, beat_list: Column, shift: Column) -> Column:
    """A report's cues as struct<kind, number, comment, time_seconds>; without any, one memory cue on the first beat."""
    own = F.transform(found, lambda c: F.struct(F.when(c["kind"] == "hot", "hot").otherwise("memory").alias("kind"), c["number"].cast("int").alias("number"), c["name"].alias("comment"), (c["time_seconds"] + shift).alias("time_seconds")))
    first = F.transform(F.slice(beat_list, 1, 1), lambda b: F.struct(F.lit("memory").alias("kind"), F.lit(1).alias("number"), F.lit("").alias("comment"), b["time_seconds"].alias("time_seconds")))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, own.cast(_CUE)).otherwise(first.cast(_CUE))


def sections(found: Column, shift: Column) -> Column:
    """A report's sections as struct<label, start_seconds, end_seconds>; those of unknown labels go."""
    known = F.filter(F.coalesce(found, F.expr("cast(array() as array<struct<label:string,start_seconds:double,end_seconds:double>>)")), lambda s: s["label"].isin(*LABELS))
    return F.transform(known, lambda s: F.struct(s["label"].alias("label"), (s["start_seconds"] + shift).alias("start_seconds"), (s["end_seconds"] + shift).alias("end_seconds")))


def duration_rounded(seconds: Column) -> Column:
    return F.greatest(F.round(seconds), F.lit(0.0)).cast("long")


def first_beat_seconds(beat_list: Column) -> Column:
    return F.coalesce(F.get(beat_list, F.lit(0))["time_seconds"], F.lit(0.0))


def centi_bpm(bpm: Column) -> Column:
    return F.greatest(F.round(bpm * 100), F.lit(0.0)).cast("long")


def beat_micros(seconds: Column) -> Column:
    """struct<ms, rest> of a time in whole microseconds: whole milliseconds and what is left."""
    micros = F.greatest(F.round(seconds * 1_000_000), F.lit(0.0)).cast("long")
    return F.struct(F.floor(micros / 1000).cast("long").alias("ms"), (micros % 1000).cast("int").alias("rest"))


def beat_at(times: Column, seconds: Column) -> Column:
    """The number, from 1, of the beat nearest to a time, the first one on ties; 1 without beats."""
    ranked = F.transform(times, lambda t, i: F.struct((-F.abs(t - seconds)).alias("near"), (-i).alias("order")))
    return F.coalesce(-F.array_max(ranked)["order"], F.lit(0)) + 1


def civil_date(days: Column) -> Column:
    """The date that many days after 1970-01-01, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def index_by(df: DataFrame, position: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(values, rows): distinct non-empty values numbered from 0 as they first appear, and df with `<column>_index`,
    null for null and empty values.

    First appearances are aggregated before anything is numbered, and numbers are sums over range partitions, so a
    column of very many values needs no single task.
    """
    from .naming import dictionary

    values = dictionary(df, position, column)
    return values, df.join(values.withColumnRenamed("code", f"{column}_index"), column, "left")


def playlist_entries(tracks: DataFrame, position: str, name: str = "All tracks") -> DataFrame:
    """(playlist, entry, <position>) of the list of all tracks in their order, entries from 1."""
    order = W.partitionBy(F.lit(name)).orderBy(position)
    return tracks.select(F.lit(name).alias("playlist"), F.row_number().over(order).alias("entry"), position)


def linked_entries(entries: DataFrame, lists: str, position: str) -> DataFrame:
    """Adds entity_id and next_entity_id: a list's entries as a linked list whose last points to 0."""
    order = W.partitionBy(lists).orderBy(position)
    rows = entries.withColumn("entity_id", F.col(lists).cast("long") * 1_000_000 + F.row_number().over(order))
    return rows.withColumn("next_entity_id", F.coalesce(F.lead("entity_id").over(order), F.lit(0)))


def ancestors(playlists: DataFrame) -> DataFrame:
    """(id, parent) of every playlist with each list above it, the 0 above the topmost included."""
    return playlists.sparkSession.sql("WITH RECURSIVE up(id, parent) AS (SELECT id, parent FROM {lists} UNION ALL SELECT up.id, p.parent FROM {lists} p JOIN up ON up.parent = p.id) SELECT * FROM up", lists=playlists.select("id", "parent"))


def descendants(playlists: DataFrame) -> DataFrame:
    """(id, child) of every playlist with each list below it."""
    return playlists.sparkSession.sql("WITH RECURSIVE down(id, child) AS (SELECT id, id FROM {lists} UNION ALL SELECT down.id, p.id FROM {lists} p JOIN down ON down.child = p.parent) SELECT * FROM down WHERE id <> child", lists=playlists.select("id", "parent"))


def playlist_paths(playlists: DataFrame) -> DataFrame:
    """(id, path, position) of rows (id, title, parent, next): the names from the topmost list down, each closed by `;`,
    and the lists' order: deeper ones first, then as the linked lists of neighbours go."""
    return playlists.sparkSession.sql(
        """WITH RECURSIVE up(id, parent, title, depth) AS (SELECT id, parent, title, 1 FROM {lists} UNION ALL SELECT up.id, p.parent, p.title, up.depth + 1 FROM {lists} p JOIN up ON up.parent = p.id),
        chain(id, place) AS (SELECT id, 1 FROM {lists} WHERE next = 0 UNION ALL SELECT p.id, chain.place + 1 FROM {lists} p JOIN chain ON p.next = chain.id),
        named AS (SELECT id, listagg(title, ';') WITHIN GROUP (ORDER BY depth DESC) || ';' AS path, max(depth) AS depth FROM up GROUP BY id)
        SELECT l.id, n.path, cast(row_number() OVER (ORDER BY n.depth DESC, c.place ASC NULLS FIRST, l.id) AS int) AS position FROM {lists} l LEFT JOIN named n ON n.id = l.id LEFT JOIN chain c ON c.id = l.id""",
        lists=playlists.select("id", "title", "parent", "next"),
    )


def performance_data(tracks: DataFrame) -> DataFrame:
    """The columns of tracks that players read while playing, under their names there."""
    names = ("isAnalyzed", "trackData", "overviewWaveFormData", "beatData", "quickCues", "loops", "thirdPartySourceId", "activeOnLoadLoops")
    return tracks.select(F.col("id").alias("trackId"), *names)


def change_log(spark) -> DataFrame:
    """(id, trackId), always empty."""
    return spark.range(0).select(F.col("id").cast("int").alias("id"), F.col("id").cast("int").alias("trackId"))


def violations(df: DataFrame, unique: list[str]) -> DataFrame:
    """(columns..., n) of the values that several rows share; nulls are never equal."""
    return df.dropna(subset=unique).groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """The rows whose column names no parent; null names none and is no orphan."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def latest_files(files: DataFrame) -> DataFrame:
    """(path, bytes, write_order) of a log of writes (path, bytes, seq): the last bytes of each path, in the order in
    which the paths were first written."""
    last = files.groupBy("path").agg(F.max_by("bytes", "seq").alias("bytes"), F.min("seq").alias("write_order"))
    return last.select("path", "bytes", "write_order")


def keep_first(df: DataFrame, name: str, order: str) -> DataFrame:
    """df without the rows whose name an earlier row has."""
    w = W.partitionBy(name).orderBy(order)
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")
