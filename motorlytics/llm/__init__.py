"""Operators of a training-data pipeline over documents, embeddings, pages and
conversations. Nothing outside this folder, its tests and ``corpus_pipeline``
imports it; ``queries`` holds the registered queries and their SQL twins."""
