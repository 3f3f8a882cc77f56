"""Tables as pages."""
