"""Part of the recovery engine; see README.md."""
