"""Graph operators: filters, joins, aggregations, rankings, closures and set operations over node and edge tables."""
