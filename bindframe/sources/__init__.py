"""sources of binding-data work."""
