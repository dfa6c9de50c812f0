"""Verdict analytics on Spark: operators for studies that use language models as judges."""
