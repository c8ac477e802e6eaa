"""Training-data operators: language id, mixing, quality ledger, secrets,
nearest neighbours, token counts, URL rules, BPE, toxicity, SimHash dedup.

Every operator takes the columns it needs by name and ignores the others, so
extra input columns (also ones called like an output) cannot clash. Nothing
outside this subpackage imports it, except the guard in ``__spark_entry__``
and ``corpus_pipeline``.
"""
