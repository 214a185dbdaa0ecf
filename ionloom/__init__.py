"""Spectral-library curation on PySpark: DataFrame operators over one ``spectra`` table."""
