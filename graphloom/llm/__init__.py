"""Training-data operators: token counts, decontamination, personal data, nearest
neighbours, toxicity, packing, deduplication, similarity joins, page extraction, secrets,
hard negatives, whitening, quality rules.

Nothing outside this subpackage imports it.
"""
