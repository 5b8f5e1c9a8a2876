"""Column builders: no actions, no Python in the data path."""
