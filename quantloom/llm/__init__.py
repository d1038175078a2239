"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is there.
"""
