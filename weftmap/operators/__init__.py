"""The relational algebra and the construction of the graph."""
