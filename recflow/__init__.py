"""recflow: conversational retrieval, ranking features and evaluation as Spark plans."""
