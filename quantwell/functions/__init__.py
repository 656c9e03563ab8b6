"""Part of quantwell."""
