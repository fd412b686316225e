"""Query plans over the driver tables: fixture views and registered queries."""
