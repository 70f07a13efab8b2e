"""The document pipeline, set at a time: every stage is a function from DataFrames to DataFrames over all documents.

Model-backed steps take an optional callable; without one they take the same way as a disabled model.
"""
