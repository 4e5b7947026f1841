"""Query catalogues and table access."""
