"""mergetide: mergeable summaries and data-preparation operators as Spark plans."""

__version__ = "0.1.0"
