"""Sievelight: benchmark-contamination analytics on PySpark."""
