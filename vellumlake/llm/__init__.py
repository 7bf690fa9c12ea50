"""Operators for preparing training text at scale.

Every operator takes and returns DataFrames.  A row without a ``doc_id`` carries
no document and is left out (but is a leaf of the manifest, and counts for phrases,
which ask for no doc_id); a null text is an empty text; other columns of the
input are ignored, so they may have any name.
"""
