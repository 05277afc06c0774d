"""A property-graph analytics engine whose plans are Spark DataFrame plans."""
