"""quern: analytics over document catalogs, on PySpark."""
