"""Part of sextant."""
