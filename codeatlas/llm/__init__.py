"""Operators for preparing training text: URL filters, sharding, fingerprints,
licence scans, language ID, chat formatting, decontamination, near-duplicate
removal, toxicity and byte-level BPE.  Nothing outside this folder imports it."""
