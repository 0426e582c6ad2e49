"""Column functions over program texts, diagnostics and type spellings."""
