"""quarry: corpus analytics as Spark jobs.  Every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
