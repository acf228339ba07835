"""Training-data operators: scoring, decontamination, fixity, dedup, mixing, PII, language."""
