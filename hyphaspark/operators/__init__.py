"""DataFrame operators: rasters, polygons, weather, spots, evaluation, observations."""
