"""Document-ledger analytics on Spark."""
