"""Functions: column expressions and small codecs."""
