"""Training-data operators: deduplication, filtering, mixing, packing, extraction and search.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only
where the subpackage is present.
"""
