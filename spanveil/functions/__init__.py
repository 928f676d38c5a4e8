"""Part of the span engine; see README.md."""
