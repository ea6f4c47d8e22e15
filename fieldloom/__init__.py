"""Evidence-based spatial analytics on PySpark."""
