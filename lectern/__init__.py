"""lectern: a Spark-first engine for time-anchored transcripts and text corpora."""

__version__ = "0.1.0"
