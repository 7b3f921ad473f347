"""Measurement tables for body and gaze recordings, on Spark."""
