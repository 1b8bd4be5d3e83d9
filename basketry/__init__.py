"""Retail basket analytics and corpus preparation as Spark jobs."""
