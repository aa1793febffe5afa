"""Brickyard: a PySpark-native engine for listing analytics and training-data pipelines."""
