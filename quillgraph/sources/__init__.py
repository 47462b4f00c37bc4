"""Where tables come from and go to: the graph store and connectors."""
