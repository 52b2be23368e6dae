"""A PySpark analytics engine for daily price panels."""
