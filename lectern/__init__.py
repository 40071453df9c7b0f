"""Prose analytics on Spark: located findings and statistics of documents, as DataFrame plans."""
