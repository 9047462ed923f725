"""Object catalog queries over a manifest table (S1, S12, F1, U3, T4, A1-A3,
X10, X11, C5, C6).

The manifest is ``objects(bucket, name, size, content_type, updated)``.
Prefix filters are ``startswith`` predicates, which Parquet scans receive as
pushed ``StringStartsWith`` filters. Folder roll-up is a distinct over the
derived folder name (map-side partial dedupe, then one small shuffle).
Listings are name-ordered before their limit, which Spark plans as a
TakeOrderedAndProject (per-partition top-n, bounded merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
GCS_SCHEME = "gs://"
PUBLIC_URL_BASE = "https://storage.googleapis.com/"
DEFAULT_MAX_BUCKETS = 50
DEFAULT_MAX_OBJECTS = 100
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
DEFAULT_UPLOAD_FOLDER = "DEV/"
PDF_TYPE = "application/pdf"
NO_ATTACHMENT = "No file found in the current message. Please upload a file and try again."
LISTING_MESSAGE = "Found %d file(s) and %d folder(s) in bucket '%s'"
DETAILS_MESSAGE = "Successfully retrieved details and %d file(s) for bucket '%s'"
LISTING_PREFIX_SUFFIX = " with prefix '%s'"
UPLOAD_MESSAGE = "Successfully uploaded file to gs://%s/"
# ----------------------------------------------------------------------------


def split_uri(uri: Column, strict: bool = True) -> tuple[Column, Column]:
    """(bucket, prefix) of a ``gs://bucket/prefix`` URI (S1): split at the
    first '/', no slash -> prefix ''. With ``strict`` a URI without the
    scheme fails the job; otherwise both parts are null for it."""
    ok = uri.startswith(GCS_SCHEME)
    rest = F.substr(uri, F.lit(len(GCS_SCHEME) + 1))
    pos = F.instr(rest, "/")
    bucket = F.when(pos > 0, F.substr(rest, F.lit(1), pos - 1)).otherwise(rest)
    prefix = F.when(pos > 0, F.substr(rest, pos + 1)).otherwise(F.lit(""))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a gs:// uri: "), F.coalesce(uri, F.lit("null"))))
        return (F.when(ok, bucket).otherwise(bad.cast("string")),
                F.when(ok, prefix).otherwise(bad.cast("string")))
    return F.when(ok, bucket), F.when(ok, prefix)


def gcs_uri(bucket: Column, name: Column) -> Column:
    return F.concat(F.lit(GCS_SCHEME), bucket, F.lit("/"), name)


def public_url(bucket: Column, name: Column) -> Column:
    return F.concat(F.lit(PUBLIC_URL_BASE), bucket, F.lit("/"), name)


def iso(ts: Column) -> Column:
    """ISO-8601 with offset; null stays null (X11)."""
    return F.date_format(ts, ISO_FORMAT)


def object_rows(objects: DataFrame) -> DataFrame:
    """Object listing rows with their URIs and ISO update time."""
    return objects.select(
        "bucket", "name", "size", "content_type", iso(F.col("updated")).alias("updated"),
        gcs_uri(F.col("bucket"), F.col("name")).alias("gcs_uri"),
        public_url(F.col("bucket"), F.col("name")).alias("public_url"))


def _in_prefix(objects: DataFrame, bucket: str | None, prefix: str | None) -> DataFrame:
    o = objects
    if bucket is not None:
        o = o.where(F.col("bucket") == F.lit(bucket))
    if prefix:
        o = o.where(F.col("name").startswith(prefix))
    return o


def folder_of(name: Column, prefix: str, delimiter: str) -> Column:
    """``prefix + segment + delimiter`` when the name has the delimiter after
    the prefix, else null (the object is listed itself) (U3)."""
    rest = F.substr(name, F.lit(len(prefix) + 1))
    pos = F.instr(rest, delimiter)
    return F.when(pos > 0, F.concat(F.lit(prefix), F.substr(rest, F.lit(1), pos - 1),
                                    F.lit(delimiter)))


def list_entries(objects: DataFrame, bucket: str | None = None, prefix: str | None = None,
                 delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, folders) of a listing before any limit: files are the objects
    with no delimiter after the prefix; folders the distinct common
    prefixes (empty without a delimiter)."""
    o = _in_prefix(objects, bucket, prefix)
    p = prefix or ""
    if not delimiter:
        return o, o.sparkSession.createDataFrame([], "bucket string, folder string, n_objects long")
    o = o.withColumn("_folder", folder_of(F.col("name"), p, delimiter))
    files = o.where(F.col("_folder").isNull()).drop("_folder")
    folders = (o.where(F.col("_folder").isNotNull())
               .groupBy("bucket", F.col("_folder").alias("folder"))
               .agg(F.count("*").alias("n_objects")))
    return files, folders


def list_objects(objects: DataFrame, bucket: str, prefix: str | None = None,
                 delimiter: str | None = None,
                 max_results: int | None = DEFAULT_MAX_OBJECTS) -> tuple[DataFrame, DataFrame]:
    """C5. Returns (entries, summary). Entries are files and folders in name
    order, at most ``max_results`` in total; the summary row has count,
    prefix_count and the listing message."""
    files, folders = list_entries(objects, bucket, prefix, delimiter)
    entries = object_rows(files).select(
        F.lit("file").alias("kind"), "name", "size", "content_type", "updated",
        "gcs_uri", "public_url").unionByName(
        folders.select(F.lit("folder").alias("kind"), F.col("folder").alias("name"),
                       F.lit(None).cast("long").alias("size"),
                       F.lit(None).cast("string").alias("content_type"),
                       F.lit(None).cast("string").alias("updated"),
                       gcs_uri(F.col("bucket"), F.col("folder")).alias("gcs_uri"),
                       public_url(F.col("bucket"), F.col("folder")).alias("public_url")))
    if max_results is not None:
        entries = entries.orderBy("name", "kind").limit(int(max_results))
    summary = entries.agg(
        F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).cast("bigint").alias("count"),
        F.sum(F.when(F.col("kind") == "folder", 1).otherwise(0)).cast("bigint").alias("prefix_count"))
    summary = summary.select(
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("prefix_count", F.lit(0)).alias("prefix_count"))
    summary = summary.withColumn("message", listing_message(
        F.col("count"), F.col("prefix_count"), bucket, prefix))
    return entries, summary


def listing_message(n_files: Column, n_folders: Column, bucket: str,
                    prefix: str | None) -> Column:
    msg = F.format_string(LISTING_MESSAGE, n_files, n_folders, F.lit(bucket))
    if prefix:
        msg = F.concat(msg, F.lit(LISTING_PREFIX_SUFFIX % prefix))
    return msg


def bucket_summary(objects: DataFrame) -> DataFrame:
    """A2 without the nested file array: one row per bucket with file count
    and bytes. File rows come from :func:`object_rows` -- a bucket's files
    are never gathered into one array (one bucket may hold most objects)."""
    return (objects.groupBy("bucket")
            .agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"),
                 F.min("name").alias("first_name"), F.max("name").alias("last_name"),
                 iso(F.max("updated")).alias("updated"))
            .withColumn("self_link", F.concat(F.lit(PUBLIC_URL_BASE), F.col("bucket"))))


def bucket_details(buckets: DataFrame, objects: DataFrame, bucket: str) -> tuple[DataFrame, DataFrame]:
    """A2/C6 of one bucket: (details, files). Details is one row with every
    column of the bucket table (id, location, storage class, versioning, labels,
    etag, ...), times in ISO form, the self link, the file count and the
    message; a bucket that does not exist gives no row. Files are the rows
    of :func:`object_rows`, not one array."""
    files = object_rows(objects.where(F.col("bucket") == F.lit(bucket)))
    n = files.agg(F.count("*")).scalar()
    row = buckets.where(F.col("name") == F.lit(bucket)).select(
        *[iso(F.col(c)).alias(c) if c in ("created", "updated") else F.col(c) for c in buckets.columns],
        F.lit(PUBLIC_URL_BASE + bucket).alias("self_link"), n.alias("file_count"))
    return row.withColumn("message", F.format_string(DETAILS_MESSAGE, "file_count", F.lit(bucket))), files


def list_buckets(buckets: DataFrame, prefix: str | None = None,
                 max_results: int | None = DEFAULT_MAX_BUCKETS) -> DataFrame:
    """A3 over a bucket table (name, location, storage_class, created,
    updated): prefix filter, name order, limit, ISO timestamps."""
    b = buckets
    if prefix:
        b = b.where(F.col("name").startswith(prefix))
    b = b.select(*[iso(F.col(c)).alias(c) if c in ("created", "updated") else F.col(c)
                   for c in buckets.columns])
    b = b.orderBy("name")
    return b.limit(int(max_results)) if max_results is not None else b


def buckets_from_objects(objects: DataFrame) -> DataFrame:
    """Bucket table derived from a manifest: (name, file_count, created,
    updated) with created/updated the oldest/newest object time."""
    return objects.groupBy(F.col("bucket").alias("name")).agg(
        F.count("*").alias("file_count"), F.min("updated").alias("created"),
        F.max("updated").alias("updated"))


def stage_attachments(messages: DataFrame, bucket: str,
                      default_type: str = PDF_TYPE) -> DataFrame:
    """For each message, the first part whose mime type starts with
    ``application/``; if its bytes are empty the message has no file (a
    later part is not tried). Destination = given name, else ``DEV/`` +
    artifact name, plus ``.pdf`` for a PDF content type when missing (only
    in that default case). Columns: message_id, status, filename, gcs_uri,
    size_bytes, content_type, data, message."""
    ctype = F.coalesce(F.col("content_type"), F.lit(default_type))
    first = F.get(F.filter("parts", lambda p: p["mime_type"].startswith("application/")), 0)
    data = first["data"]
    has = data.isNotNull() & (F.length(data) > 0)
    default_name = F.concat(F.lit(DEFAULT_UPLOAD_FOLDER), F.col("artifact_name"))
    default_name = F.when((ctype == PDF_TYPE) & ~F.lower(default_name).endswith(".pdf"),
                          F.concat(default_name, F.lit(".pdf"))).otherwise(default_name)
    dest = F.when(F.coalesce(F.col("destination"), F.lit("")) != "", F.col("destination")) \
        .otherwise(default_name)
    return messages.select(
        "message_id",
        F.when(has, "success").otherwise("error").alias("status"),
        F.when(has, dest).alias("filename"),
        F.when(has, F.concat(F.lit(GCS_SCHEME + bucket + "/"), dest)).alias("gcs_uri"),
        F.when(has, F.length(data)).alias("size_bytes"),
        F.when(has, ctype).alias("content_type"),
        F.when(has, data).alias("data"),
        F.when(has, F.concat(F.lit(UPLOAD_MESSAGE % bucket), dest)).otherwise(F.lit(NO_ATTACHMENT)).alias("message"))
