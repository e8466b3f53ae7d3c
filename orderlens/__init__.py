"""Order analytics on Spark: star joins, KPIs, checks, tiering and streaming ingest."""
