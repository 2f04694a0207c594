"""Part of braidseq; see the module docstrings."""
