"""Query bindings over the driver tables, each with its SQL oracle."""
