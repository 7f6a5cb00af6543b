"""Training-data operators: language identification, deduplication, decontamination, secrets,
personal data, packing, toxicity, page extraction and nearest-neighbour search.

Nothing outside this subpackage imports it.
"""
