"""ledgerspark: rule-driven financial rollups, control checks and log analytics on Spark."""
