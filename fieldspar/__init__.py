"""Report analytics on Spark: facts, joins, robust statistics, search and grounded answers as lazy plans."""
