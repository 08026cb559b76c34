"""The same alerts and loads from streams."""
