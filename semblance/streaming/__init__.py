"""Applying fitted transforms to streams."""
