"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; deleting it leaves the rest of the package working.
"""
