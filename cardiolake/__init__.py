"""Spark-native analytics for cardiotocography (fetal heart rate and contraction) series."""
