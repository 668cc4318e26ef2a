"""Training-data operators: each module is one operator with its own interface.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` uses it.
"""
