"""Labelled text corpora as Spark jobs: crawl tables, clean, tag, vectorise, cluster, classify."""
