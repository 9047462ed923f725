"""tessera: retrieval, ingestion, web search, object catalog and governed
turn logs as Spark jobs.

The public operators, one per tool of the reference assistant (each a
``DataFrame -> DataFrame`` function over tables):
"""

from .functions.sql import register_sql_functions
from .operators.catalog import bucket_summary, list_buckets, list_objects, stage_attachments
from .operators.governance import assemble_turns, log_rows, verbose_rows, write_log
from .operators.ingest import plan_ingest, run_ingest, texts_from_files
from .operators.knn import ivf_index, topk_dense, topk_ivf, topk_sparse
from .operators.retrieval import context, retrieve, retrieve_datapoints
from .operators.sessions import (activity_sessions, ingest_memory, memory_rows, recent_sessions,
                                 report_text, scoped_topk, session_tail)
from .operators.upsert import merge, upsert_batches
from .operators.web import bm25, fallback, fetch_pages, page_index, web_search

__all__ = [
    # knowledge search: retrieve_documents, build_and_upsert
    "retrieve", "context", "retrieve_datapoints", "plan_ingest", "run_ingest",
    "texts_from_files", "merge", "upsert_batches",
    "topk_sparse", "topk_dense", "ivf_index", "topk_ivf",
    # web: google_search, fetch_search_pages
    "web_search", "page_index", "fetch_pages", "bm25", "fallback",
    # storage: list_buckets, get_bucket_details, list_blobs, upload_file
    "list_buckets", "bucket_summary", "list_objects", "stage_attachments",
    # datetime: timestamped report
    "report_text",
    # governance plugin and log
    "assemble_turns", "verbose_rows", "log_rows", "write_log",
    # sessions and memory
    "activity_sessions", "recent_sessions", "session_tail", "memory_rows", "ingest_memory",
    "scoped_topk",
    # SQL surface
    "register_sql_functions",
]
