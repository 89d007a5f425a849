"""Catalogue facts on Spark: extraction, levelling, derivation, merging and monitoring as DataFrame jobs."""
