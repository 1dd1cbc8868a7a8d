"""Training-data operators: URL filters, sharding, licence scans, toxicity, decontamination,
language identification, near and substring deduplication, BPE and quality rules.

Nothing else in the library imports this subpackage.
"""
