"""Training-data operators: near-duplicate search, filters, mixing, packing, archives.

Nothing outside this subpackage imports it; it imports only Spark, numpy, pandas
and pyarrow, so it can be removed together with ``tests/llm``.
"""
