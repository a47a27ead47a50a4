"""lakevec: vector search, document ingestion and pivot analytics as Spark DataFrame jobs."""
