"""lintlake: code-quality analytics over large source corpora, as Spark jobs.

Public functions take and return DataFrames.  Nothing here calls an action, keeps a
clock or a cache: look-back reports take ``as_of`` so a run can be repeated.
"""
