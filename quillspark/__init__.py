"""quillspark: corpus ingestion, retrieval and training-data preparation as Spark jobs."""
