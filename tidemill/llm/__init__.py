"""Training-data operators: dedup, joins, packing, language ID, extraction and rules.

Nothing else in the library imports this subpackage.
"""
