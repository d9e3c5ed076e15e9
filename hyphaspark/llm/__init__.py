"""Training-data operators: thirteen text, vector and conversation operators built as Spark jobs."""
