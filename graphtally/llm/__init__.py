"""Operators for training-data pipelines over a ``documents`` table.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its
queries only when it can be imported.  One module per operator, ``queries`` binds
them to the tables, ``oracles`` holds the SQL twins.
"""
