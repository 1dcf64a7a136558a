"""Inputs: the catalogues, the file-tree reader and the corpus table."""
