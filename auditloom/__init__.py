"""Corpus-audit analytics on Spark: scans, findings, roll-ups, packing and streams.

Every operator takes and returns Spark DataFrames (or builds a Column), works on all
repositories of a table at once, and leaves physical planning to Catalyst and AQE.
"""

__version__ = "0.1.0"
