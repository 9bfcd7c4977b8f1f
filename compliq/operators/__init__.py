"""Relational operators over exploded blocks, manifests and instruction lines."""
