"""Training-data operators: thirteen Spark jobs over documents, pages and embeddings.

Nothing outside this subpackage imports it. ``entry`` maps query names to
callables; each operator lives in a module of its own.
"""
