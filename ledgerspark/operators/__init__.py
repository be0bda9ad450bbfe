"""DataFrame operators: backfill, reconciliation, load, sessions and grading."""
