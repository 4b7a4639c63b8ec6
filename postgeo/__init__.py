"""postgeo: Spark jobs for job postings on a map."""
