"""Gazette search, ingest, maintenance and extraction on Spark."""
