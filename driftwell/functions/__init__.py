"""Part of driftwell."""
