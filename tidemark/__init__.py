"""Replication and merging of versioned tables as Spark dataflows."""
