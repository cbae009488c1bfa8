"""corpusloom: analysis and retrieval over large document collections, as Spark DataFrame functions."""
