"""Operators of a training-data pipeline: deduplication, scoring, joins, packing, encoding.

Every module holds one operator with a general interface; ``queries`` registers the
production use of each on the tables ``documents``, ``embeddings`` and ``pages``.
Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it."""
