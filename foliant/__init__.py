"""foliant: document, translation-quality and ledger analytics on PySpark."""
