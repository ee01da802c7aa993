"""shelfspark: PySpark-native analytics for ordered physical collections such as library shelves."""
