"""Operators of a training-data pipeline over `documents` (doc_id, text, ...).

Every operator reads the columns it names and ignores all others, so extra
columns of any name do no harm. Nothing outside this package imports it.
"""
