"""Operators for large training corpora: packing, deduplication, mixing, classification and search.

Nothing outside this folder imports it; ``lodestar.llm.queries`` lists what it offers to the driver.
"""
