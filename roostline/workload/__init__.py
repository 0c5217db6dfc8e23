"""The library's analyses over the given driver tables."""
