"""Training-data operators: deduplication, packing, token files, language, decontamination, extraction, toxicity.

Nothing outside this subpackage imports it.
"""
