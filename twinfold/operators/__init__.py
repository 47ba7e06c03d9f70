"""DataFrame-to-DataFrame operators: features, joins, clustering, search, reports."""
