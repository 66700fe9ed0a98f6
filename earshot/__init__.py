"""A PySpark engine for preparing, indexing, searching and evaluating spoken-word transcript corpora."""
