"""Lead search, lead analytics and lead ingestion as composable Spark DataFrame operators."""
