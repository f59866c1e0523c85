"""Static extraction: source texts to nodes and edges.

Producers are plain functions over (service, path, text) that yield records;
one Arrow-batched map runs them all over each file, and the graph is folded
from the records with aggregations.  Python is parsed exactly (``ast``); other
languages are read by patterns, which is an approximation.
"""
