"""A PySpark engine for resolving noisy records to reference entities."""
