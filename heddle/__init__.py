"""heddle: GoogleSQL-style analytics and data-processing jobs, expressed as idiomatic PySpark."""

__version__ = "0.1.0"
