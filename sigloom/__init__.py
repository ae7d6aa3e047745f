"""Signal research and training-data operators as declarative Spark plans."""
