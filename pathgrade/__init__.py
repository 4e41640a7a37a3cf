"""pathgrade: Spark-native analytics over agent trajectories, raters and training text."""
