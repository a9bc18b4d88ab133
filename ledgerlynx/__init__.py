"""ledgerlynx: financial-crime analytics on large tables and streams, as Spark jobs."""
