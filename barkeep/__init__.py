"""barkeep: Spark jobs that keep large stores of market bars and funding rates in good order."""
