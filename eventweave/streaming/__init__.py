"""The same counts over a stream of files."""
