"""Streaming tomography analytics on Spark: ingest, clean, window, reconstruct, score."""
