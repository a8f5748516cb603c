"""Operators of a training-data pipeline over ``documents``, ``pages``, ``conversations``,
``embeddings`` and ``benchmark``.

Nothing else in the library imports this subpackage.
"""
