"""Spark operators for clinical-prescribing analytics."""
