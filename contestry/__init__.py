"""contestry: analytics for recurring contests between two sides, on PySpark."""
