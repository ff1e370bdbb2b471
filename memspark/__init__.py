"""memspark: PySpark jobs that turn documents and chat transcripts into an organized, searchable memory."""
