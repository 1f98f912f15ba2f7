"""Append-only inputs read as streams and applied batch by batch with the batch operators."""
