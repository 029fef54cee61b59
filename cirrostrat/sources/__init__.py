"""Reading ensembles and writing results."""
