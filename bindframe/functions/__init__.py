"""functions of binding-data work."""
