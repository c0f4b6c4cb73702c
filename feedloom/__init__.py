"""Catalog enrichment and scoring as Spark jobs: feeds in, complete and traceable catalog tables out."""
