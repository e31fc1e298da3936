"""Operators over DataFrames of frames, windows, episodes, events and questions."""
