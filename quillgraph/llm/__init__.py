"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing outside this package imports it.  Each module holds one operator with
a general interface, the thin query ``opN_<name>`` over the driver's tables,
and SQL for it where SQL can express it.  :mod:`.registry` lists them.
"""
