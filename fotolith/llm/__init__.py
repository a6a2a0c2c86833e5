"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it, so it can be removed; of the rest it
uses only what sends the package to the executors and names the shared folder.
"""
