"""Part of parchment; see the package README."""
