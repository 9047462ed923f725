"""File corpora (S2, S3, S4): list objects by extension, decode text,
assemble extracted PDF pages.

``binaryFile`` lists recursively; only metadata columns are selected for the
listing, so file contents are not read for files the extension filter drops.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DEFAULT_EXTENSIONS = (".pdf", ".txt")
REPLACEMENT_CHAR = "�"
# Characters of page texts handed on at once.
PAGE_BYTES = 4 << 20
# ----------------------------------------------------------------------------


def _ext_pattern(exts) -> str:
    import re
    return "(" + "|".join(re.escape(e.lower()) for e in exts) + ")$"


def _ext_glob(exts) -> str:
    """File-name glob of the extensions in either case."""
    either = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts)
    return "*{" + ",".join(either) + "}"


def with_extensions(df: DataFrame, uri_col: str = "uri",
                    exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """rows whose lower-cased uri ends with one of ``exts`` (the uri
    keeps its case)."""
    return df.where(F.lower(F.col(uri_col)).rlike(_ext_pattern(exts)))


def list_files(spark: SparkSession, root: str,
               exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """(uri, length, modified) of every file below ``root`` whose lower-cased
    name ends with one of ``exts``; the uri keeps its original case."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .load(root))
    return (df.select(F.col("path").alias("uri"), "length",
                      F.col("modificationTime").alias("modified"))
            .where(F.lower("uri").rlike(_ext_pattern(exts))))


def read_corpus(spark: SparkSession, root: str,
                exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """(uri, content, length, modified) of the matching files below
    ``root``: one distributed scan; other files are not opened."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", _ext_glob(exts)).load(root))
    return (df.where(F.lower("path").rlike(_ext_pattern(exts)))
            .select(F.col("path").alias("uri"), "content", "length",
                    F.col("modificationTime").alias("modified")))


def decode_text(content) -> "F.Column":
    """UTF-8 decode with invalid bytes dropped (S3): Spark maps them to
    U+FFFD, which is then removed."""
    return F.replace(F.make_valid_utf8(content.cast("string")),
                     F.lit(REPLACEMENT_CHAR), F.lit(""))


def read_text_files(spark: SparkSession, root: str,
                    exts: tuple[str, ...] = (".txt",)) -> DataFrame:
    """(uri, text) of the text files below ``root``, decoded in the scan."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", _ext_glob(exts)).load(root))
    return (df.where(F.lower("path").rlike(_ext_pattern(exts)))
            .select(F.col("path").alias("uri"), decode_text(F.col("content")).alias("text")))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """(uri, page_no, text) -> (uri, text): page texts joined by a newline
    in page order, a null page as ''. The list per file is bounded by its
    page count."""
    return (pages.groupBy("uri").agg(
        F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t"))))
        .alias("_p"))
        .select("uri", F.array_join(F.transform("_p", lambda x: x["t"]), "\n").alias("text")))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """Run a caller-supplied page extractor (e.g. a PDF library) on
    (uri, content) rows, one object at a time: one output row per page, in
    frames of about ``PAGE_BYTES``; a file the extractor cannot read yields one
    empty page, a page it cannot read an empty text."""
    names = ["uri", "page_no", "text"]

    def frames(uri, content):
        try:
            pages = extractor(content)
        except Exception:
            pages = [""]
        held, size = [], 0
        for i, t in enumerate(pages):
            held.append((uri, i, t if isinstance(t, str) else ""))
            size += len(held[-1][2])
            if size > PAGE_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for b in batches:
            for uri, content in zip(b.column("uri"), b.column("content")):
                for rows in frames(uri.as_py(), content.as_py()):
                    u, n, t = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u, pa.string()), pa.array(n, pa.int32()), pa.array(t, pa.string())], names)

    return files.select("uri", "content").mapInArrow(run, "uri string, page_no int, text string")
