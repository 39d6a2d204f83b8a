"""Training-data operators: near-duplicates, secrets, decontamination, language
model scoring, quality, mixing, chat formatting, page text, token counts, filter audit,
sharding and importance resampling.

Nothing else in the library imports this package. Each operator takes a
DataFrame and column names and returns a DataFrame; ``queries`` holds the thin
``opN_*`` queries that apply them to the test tables.
"""
