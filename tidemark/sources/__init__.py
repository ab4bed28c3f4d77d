"""Topics, parsers, document tables and the views over the driver's tables."""
