"""Spark-native preparation of irregular tables: typing, profiling, reshaping, reconciling and layered loading."""
