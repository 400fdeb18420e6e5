"""Spark-native analytics over sparse voxel hierarchies."""
