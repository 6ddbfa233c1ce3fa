"""DataFrame to DataFrame operators of the catalogue engine."""
