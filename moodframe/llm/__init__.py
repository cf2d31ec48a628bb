"""Training-data operators: near-duplicates, quality, language, search,
personal data, language-model scoring, packing, mixing and chat formatting.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
plus column names, selects only the columns it names (extra or clashing
columns are ignored) and returns a DataFrame; ``queries`` holds the registered
``opN_<name>`` queries.
"""
