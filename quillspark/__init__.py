"""A retrieval and document-analytics engine expressed as Spark DataFrame plans."""
