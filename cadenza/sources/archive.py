"""Audio files inside zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The extensions of audio files.
EXTENSIONS = ("wav", "aiff", "aif", "flac", "mp3")


def is_audio(name: str) -> bool:
    """Whether an entry's name is that of an audio file, and not of the resource fork that is zipped beside one."""
    own = name.rsplit("/", 1)[-1]
    if name.startswith("__MACOSX/") or own.startswith("._") or "." not in own:
        return False
    return own.rsplit(".", 1)[1].lower() in EXTENSIONS


def read_archives(spark: SparkSession, folder: str, contents: bool = True) -> DataFrame:
    """(archive, position, name, file_name, size, content, error) of every audio entry of the folder's .zip files.

    One entry is in memory at a time beside its archive. position counts an archive's entries in its own order.
    An archive or entry that can't be read has its reason in `error`; without `contents`, content is null.
    """
    schema = "archive string, position int, name string, file_name string, size long, content binary, error string"
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def entries(archive: str, data: bytes) -> Iterator[tuple]:
        try:
            opened = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            yield archive, None, None, None, None, None, str(error)
            return
        with opened:
            for position, info in enumerate(opened.infolist()):
                if info.is_dir() or not is_audio(info.filename):
                    continue
                content, reason = None, None
                if contents:
                    try:
                        content = opened.read(info)
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as error:
                        reason = str(error)
                yield archive, position, info.filename, info.filename.rsplit("/", 1)[-1], info.file_size, content, reason

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("path"), batch.column("content"), strict=True):
                for row in entries(archive.as_py(), data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["archive", "position", "name", "file_name", "size", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder)
    return files.select("path", "content").mapInArrow(rows, schema)
