"""Parameters and the registered queries."""
