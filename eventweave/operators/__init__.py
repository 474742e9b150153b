"""Operators a reader, a builder or a model step is made of; each takes and returns DataFrames."""
