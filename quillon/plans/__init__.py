"""Expression and statement nodes and their rendering to Spark SQL."""
