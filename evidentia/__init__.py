"""Evidence-ledger analytics as Spark plans."""
