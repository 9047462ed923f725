"""Training-data operators: extraction, filtering, deduplication, scoring,
token output and packing, each as a Spark job.

Nothing outside this package imports it. ``tessera.llm.queries`` registers the
``opN_*`` queries that apply the operators to the whole tables.
"""
