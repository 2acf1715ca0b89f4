"""Queries over the driver's tables and their independent SQL, used by ``__spark_entry__``."""
