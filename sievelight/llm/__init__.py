"""Training-data operators: filters, near-duplicate search, decontamination, PII and mixing.

Each operator module takes and returns DataFrames.  ``queries`` registers the
contract queries; nothing outside this subpackage imports it.
"""
