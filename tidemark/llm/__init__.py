"""Training-data operators: secret scans, mixing, chat formatting, licence scans, token counts,
MinHash and embedding near-duplicates, HTML extraction, language ID and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
