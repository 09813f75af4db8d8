"""weftline: a Spark-first analytics engine for linked entities, events, places and texts."""
