"""Operators for large-scale training-data preparation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so the
folder can be removed without touching the rest of the library.
"""
