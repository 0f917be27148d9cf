"""Operators on statements; each module lists its queries as QUERIES: name -> (callable, SQL or None)."""
