"""Reading and writing tables, corpora and reports."""
