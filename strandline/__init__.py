"""strandline: positional-evidence analytics as lazy DataFrame-to-DataFrame operators on PySpark."""
