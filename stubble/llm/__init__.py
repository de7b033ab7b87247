"""Training-data operators: sharding, tokens, filters, near duplicates, quality, packing.

Nothing outside this folder imports it. Operators live in one module each; the driver
queries over them are in ``stubble.llm.queries``.
"""
