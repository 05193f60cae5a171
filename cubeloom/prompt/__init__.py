"""Prompt state: an ordered fold of edits, rendered in one of several styles on the driver."""
