"""Part of vigilake."""
