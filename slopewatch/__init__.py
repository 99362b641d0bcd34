"""Spark-native landslide-risk analytics: district rainfall, events, risk scores, alerts, features and labels."""
