"""The streaming forms of batch operators."""
