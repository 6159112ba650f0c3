"""daytrace: a PySpark-native analytics engine for activity history."""
