"""Part of the reviewlens engine."""
