"""Column functions: pure expressions from columns to a column, always evaluated on the JVM side."""
