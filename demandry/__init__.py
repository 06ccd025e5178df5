"""Demand planning and inventory analytics as set-based Spark jobs."""
