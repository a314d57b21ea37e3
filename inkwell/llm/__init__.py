"""Training-data operators: deduplication, filtering, scoring, tokenising.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with at least the columns it names (extra columns are ignored or carried
through untouched) and returns a DataFrame; models are trained from the data.
"""
