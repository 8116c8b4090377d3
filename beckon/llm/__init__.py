"""Training-data operators: thirteen components of a corpus pipeline and the queries that apply them."""
