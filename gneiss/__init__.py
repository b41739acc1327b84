"""PySpark-native analytics over content-addressed model-checkpoint metadata."""
