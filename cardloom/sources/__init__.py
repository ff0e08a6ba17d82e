"""Tables: fixed prices, the bridge from the driver tables, readers and writers."""
