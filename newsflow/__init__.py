"""newsflow: a PySpark-native news-feed pipeline and query layer."""
