"""Event-time streams; every operator takes batch or streaming DataFrames where Spark allows both."""
