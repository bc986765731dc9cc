"""Spark-native geo-genetic analytics: keyed DataFrame pipelines from genotypes to location error metrics."""
