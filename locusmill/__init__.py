"""locusmill: interval and coverage analytics on Spark."""
