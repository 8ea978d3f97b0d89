"""Tables derived from the driver data, and the registered queries."""
