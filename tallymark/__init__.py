"""Content fingerprints, change detection and path tools for Spark."""
