"""Training-data operators: tokenising, near-duplicate joins, archives, filters, mixing and vector search.

Each module holds one operator with its own general interface; ``queries`` has the
thin registered queries and their SQL. Nothing else in the library imports this folder.
"""
