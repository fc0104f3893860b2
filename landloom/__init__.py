"""Spark-native analytics over multi-temporal categorical grids, road networks and city panels."""
