"""tidecube: trips to demand cube to forecasts to serving tables, as plain Spark jobs."""
