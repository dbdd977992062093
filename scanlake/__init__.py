"""Code-security analytics over large corpora, written as Spark DataFrame jobs."""
