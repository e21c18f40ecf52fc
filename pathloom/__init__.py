"""pathloom: file search, ranking, change logs and text curation as PySpark DataFrames."""

__version__ = "0.1.0"
