"""quire: document-package analytics on Spark DataFrames."""
