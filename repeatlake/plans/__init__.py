"""Session helpers and registered queries."""
