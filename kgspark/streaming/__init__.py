"""Appending to a graph from streams; an extension, as the model itself knows no streams."""
