"""Layered processing of trip and delay records on Spark."""
