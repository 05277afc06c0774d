"""Query graphs and triple patterns as join plans."""
