"""Incremental ingestion: the sentence chain is stateless, so a stream of documents runs through it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.corpus import sentences


def sentence_stream(documents: DataFrame) -> DataFrame:
    """Sentences of a streaming (or bounded) table ``doc_index, text``; append mode, no state, no watermark."""
    return sentences(documents)
