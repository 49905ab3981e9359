"""Receivables and demand analytics on Spark: lazy DataFrame operators and ML pipelines."""
