"""papertrail: corpus-scale document-evidence analytics on PySpark."""
