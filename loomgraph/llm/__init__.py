"""Training-data operators: dedup, chat formatting, scoring, filtering, sharding, mixing.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` belongs to it.
"""
