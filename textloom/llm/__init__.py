"""Training-data operators for very large corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which belongs to it) imports it.
Each module holds one operator with a general interface; ``queries`` binds the operators to the
standard tables, with the parameters meant for production.
"""
