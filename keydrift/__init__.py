"""keydrift: configuration-drift analytics over fleets of repositories, on Spark."""
