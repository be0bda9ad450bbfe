"""Job plans: rules bound to sources, validation, rollup, release and load."""
