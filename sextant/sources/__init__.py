"""Loading, naming and registering tables."""
