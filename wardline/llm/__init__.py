"""Training-data operators: sanitising, scoring, mixing, joining, searching and packing text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns DataFrames;
the digest queries over the driver tables are in :mod:`wardline.llm.queries`.
"""
