"""Query and search towers: dense layers over vector tables and their join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.functions.vectors import append, as_double


def dense_forward(vectors: DataFrame, key: str, vec: str, layers: list[tuple], out: str = "vec") -> DataFrame:
    """Apply ``relu(x·W + b)`` layers to every vector of a table, without a shuffle.

    ``layers`` is a list of ``(W, b)`` arrays, ``b`` may be ``None``. Their size is
    fixed by the model, not by the data.
    """
    weights = [(np.asarray(w, float), None if b is None else np.asarray(b, float)) for w, b in layers]
    key_type = vectors.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = arrow.matrix(batch["x"])
            for w, b in weights:
                x = np.maximum(x @ w if b is None else x @ w + b, 0.0)
            yield arrow.batch(**{key: batch[key], out: x})

    rows = vectors.select(key, as_double(F.col(vec)).alias("x"))
    return rows.mapInArrow(apply, f"`{key}` {key_type}, `{out}` array<double>")


def fold_bias(items: DataFrame, vec: str, bias: str, out: str = "embedding_query") -> DataFrame:
    """``[w ‖ b]``: with ``[h ‖ 1]`` on the other side the inner product is ``h·w + b``."""
    return items.withColumn(out, append(as_double(F.col(vec)), F.col(bias)))


def fold_one(contexts: DataFrame, vec: str, out: str = "embedding_search") -> DataFrame:
    """``[h ‖ 1]``."""
    return contexts.withColumn(out, append(as_double(F.col(vec)), F.lit(1.0)))


def id_index_map(samples: DataFrame, video: str, idx: str) -> DataFrame:
    """Distinct ``(video_id, idx)`` pairs of a sample table."""
    return samples.select(F.col(video).alias("video_id"), F.col(idx).alias("idx")).distinct()


def tower_join(search: DataFrame, search_ids: DataFrame, query: DataFrame, query_ids: DataFrame) -> DataFrame:
    """Vectors by index → vectors by video: both towers of every video that has both."""
    s = search.join(search_ids, "idx").select("video_id", "embedding_search")
    q = query.join(query_ids, "idx").select("video_id", "embedding_query")
    return s.join(q, "video_id").select("video_id", "embedding_search", "embedding_query")
