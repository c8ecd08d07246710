"""DataFrame operators over values, fields and registry rows."""
