"""No stream operators: inputs are whole tables and documents.

Row-local functions (``functions.text``, ``quality.scan_text``,
``corpus.scan_markers``) take streaming DataFrames unchanged.
"""
