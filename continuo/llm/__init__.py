"""Training-data operators (sharding, packing, language ID, dedup, decontamination, search, output).

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""
