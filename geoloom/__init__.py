"""geoloom: geospatial and road-network analytics expressed as Spark plans."""
