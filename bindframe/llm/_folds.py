"""Folds by checksum, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindframe.llm._common import BROADCAST_ROWS_BY_TEXTS, small_side, stash, text_or_empty


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_fold: int, folds: int, most: int | None = None, id_col: str = "doc_id", text_col: str = "text", most_bytes: int | None = None) -> DataFrame:
    """(text, label) of labelled documents outside the held fold; with `most`, the so many with the smallest key hash.

    With `most_bytes` too, documents of over a sixteenth of it are left out, and of the others whole ones go, from the
    greatest key hash on, until at most so many bytes are left; sizes are summed over at most `most` keys.
    """
    marks = labels.select(F.col(id_col).alias("_key"), F.col(label).cast("int").alias("label")).where("_key is not null and label is not null").groupBy("_key").agg(F.max("label").alias("label"))
    marks = marks.where(fold(F.col("_key"), folds) != held_fold)
    if most is not None:
        marks = marks.orderBy(F.xxhash64("_key"), "_key").limit(most)
    marks = small_side(stash(marks), BROADCAST_ROWS_BY_TEXTS)
    slim = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text"))
    if most is not None and most_bytes is not None:
        sizes = slim.join(marks, F.col("_doc") == F.col("_key")).groupBy("_key", "label").agg(F.sum(F.octet_length("text")).alias("_size")).where(F.col("_size") <= most_bytes // 16)
        run = F.sum("_size").over(Window.orderBy(F.xxhash64("_key"), "_key"))
        marks = small_side(stash(sizes.withColumn("_run", run).where(F.col("_run") <= most_bytes).select("_key", "label")), BROADCAST_ROWS_BY_TEXTS)
    return slim.join(marks, F.col("_doc") == F.col("_key")).select("text", "label")
