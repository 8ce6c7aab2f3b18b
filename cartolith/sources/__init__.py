"""Sources and sinks: vector tiles and GeoJSON."""
