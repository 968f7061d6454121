"""operators of binding-data work."""
