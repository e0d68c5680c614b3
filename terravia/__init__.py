"""Spatial-accessibility and survey-weighting analytics on PySpark."""
