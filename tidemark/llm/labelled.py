"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """doc_id, text, label (int): at most ``rows`` labelled documents, the first by a hash of their id.

    ``learn`` says over doc_id which rows may be learned from. Ids that are labelled more than once take
    the larger label; null ids and labels are no labels. Picking reads the label table alone; the picked ids
    (``rows`` at most) are broadcast to the documents, whose picked rows are written once.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return materialise(texts(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "labelled")
