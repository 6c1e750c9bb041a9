"""tidewright: trade-flow panels, forecasts and marts as Spark DataFrame operators."""
