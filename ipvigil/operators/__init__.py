"""DataFrame-to-DataFrame operators: aggregates, rankings, joins, decisions."""
