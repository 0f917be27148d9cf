"""Account-statement analytics on Spark: line parsing, reconciliation, candidate scoring and a page ledger."""
