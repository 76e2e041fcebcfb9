"""tablesage: profile tables, link text to them, and judge batches of queries on Spark."""
