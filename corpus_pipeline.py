"""A corpus from documents to packed sequences, in five written stages.

All stages take rows as they come: columns beyond those of documents pass through to the last one, whatever their names;
rows with a null doc_id are rows like others; repeated rows stay repeated unless a stage says otherwise; very long texts
are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import line_dedup, mixing, ngram_join, packing, quality
from cadenza.llm.common import discard, fresh, shared_dir, stash_folder
from cadenza.llm.queries import KEEP, tokenizer_path


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below KEEP; all other rows and columns stay as they are.

    A null or empty text has the score of the model's bias. Equal texts share their fate. Without labels every score
    is 0.5, below KEEP: an unlabelled corpus keeps nothing.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "score")[0]
    return quality.score(docs, model, name=name).where(F.col(name) >= KEEP).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all documents but the first; a document that loses all its lines goes.

    n_chars follows the text where that changed. Null and empty texts have one empty line, which is never dropped. Rows
    that share a doc_id are one document, so a line that only they hold stays in all of them; null ids are one document,
    the first of all.
    """
    lines, dropped = fresh(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(docs).where(F.col(dropped) < F.col(lines))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links connect: the smallest doc_id's, null ones last.

    What goes is decided by doc_id and text together. Of several texts of that doc_id in the group, the one with the
    least hash stays, and of several such rows the least by all columns. Rows of the doc_id in other groups are not
    touched. Texts without words, null ones too, link with nothing and all stay, as repeated rows as well.
    """
    found = ngram_join.copy_marks(docs)
    mark = ngram_join.text_mark(F.col("text"))

    def listed(marks: DataFrame, how: str) -> DataFrame:
        marks = marks.select(F.col("doc").alias("doc_"), F.col("mark").alias("mark_"))
        return docs.join(marks, docs["doc_id"].eqNullSafe(marks["doc_"]) & (mark == marks["mark_"]), how)

    many = found.where("kept and n > 1")
    if many.isEmpty():
        return listed(found.where("not kept"), "left_anti").select(*docs.columns)
    single = listed(many, "left_semi").groupBy("doc_id", mark.alias(fresh(docs, "mark")[0])).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return listed(found.where("not kept or n > 1"), "left_anti").select(*docs.columns).unionByName(single)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources by their weights: every document once at least, those of small sources up to twice.

    A null source is one more source; a text without words counts as one token. Rows that agree in source, doc_id and
    text are drawn together, as often as each other. Sources of equal size have equal weights.
    """
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every drawn copy's pieces into sequences of at most 2048 tokens: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), one row a piece, the columns of documents gone.

    Null and empty texts are the closing token alone. Copies and rows that share a doc_id are packed each for itself. A
    small word table leaves the workers that other stages use next their room.
    """
    return packing.pack_documents(docs, tokenizer_path(), words=500_000).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next.

    A stage's folder goes when the next stage is written; the last one's, which the result reads, when the process ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        path = stash_folder(spark, f"{base}/{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
