"""Training-data operators: scoring, scanning, filtering, deduplication, packing.

Nothing outside this folder (and the optional ``corpus_pipeline`` at the
repository top) imports it.
"""
