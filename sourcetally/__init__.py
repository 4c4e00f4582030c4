"""Analytics over large collections of source files, as PySpark DataFrame jobs."""
