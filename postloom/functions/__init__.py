"""Part of postloom; see the README for the map of modules."""
