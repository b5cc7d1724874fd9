"""Operators for preparing training data: search, sharding, dedup, mixing, packing, token counts, language ID, HTML.

Nothing outside this subpackage imports it.  Each module documents its operator, the method it uses and what it
returns for nulls, empty tables, ties and repeated rows; ``queries`` holds the thin ``opN_*`` queries.
"""
