"""Part of the cadenza engine."""
