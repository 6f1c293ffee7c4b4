"""Operations of a training-data pipeline: cleaning, deduplication, search, tokens, packing and sharding.

Conventions shared by all operators. Column names are arguments; other columns of the input are
ignored, so clashing names cannot interfere. A NULL text counts as empty and gets a result row. A NULL
identifier is a value of its own that sorts first. Repeated rows give repeated result rows. Empty
tables give empty results with the same columns.
"""
