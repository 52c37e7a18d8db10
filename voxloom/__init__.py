"""voxloom: Spark-native analytics over annotated image volumes."""
