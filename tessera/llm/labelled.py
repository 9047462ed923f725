"""Bounded labelled samples for the classifiers.

``labelled_sample`` draws at most ``bound`` labelled rows, those with the
smallest hash of their id, attaches their texts, and keeps one of the rows that
agree in the label and in all of ``SKETCHES`` smallest hashes of word pairs:
copies of a text, and few others. The bound is the only other limit: a model is
fitted on the sample and says its number of rows; everything it is applied to
is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import LETTER, Words, mix, slices, staged

SKETCHES = 8


def _sketch(batches):
    """Smallest hashes of each text's word pairs, for thinning near copies."""
    for b in slices(batches, "text"):
        w = Words(b.column("text"), LETTER)
        h = w.hashes()
        pair = mix(h + np.append(h[1:], np.uint64(0)) * np.uint64(3))
        out = []
        for k in range(SKETCHES):
            v = mix(pair ^ np.uint64(0x51ED27 * (k + 1)))
            low = np.zeros(len(w.first) - 1, np.uint64)
            some = np.diff(w.first) > 0
            if some.any():
                low[some] = np.minimum.reduceat(v, w.first[:-1][some])
            out.append(pa.array(low.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *out],
                                         ["id", "y", *(f"m{k}" for k in range(SKETCHES))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (id, y, text) of at most ``bound`` rows of ``labels`` (id_col,
    label), one row of copies that have the same label; ids of any type.

    Rows with a null id, label or text are left out; an id with two labels
    takes the smaller, an id with two texts the lesser text."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y")) \
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .where("text IS NOT NULL")
    # at most `bound` rows of (id, y): a proven size
    rows = staged(texts.join(F.broadcast(lab), "id").groupBy("id", "y")
                  .agg(F.min("text").alias("text")), "labelled")
    names = [f"m{k}" for k in range(SKETCHES)]
    schema = StructType([rows.schema["id"], rows.schema["y"],
                         *(StructField(n, LongType()) for n in names)])
    one = rows.mapInArrow(_sketch, schema).groupBy("y", *names).agg(F.min("id").alias("id"))
    return staged(rows.join(F.broadcast(one.select("id")), "id"), "labelled-thin")
