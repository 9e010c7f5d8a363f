"""Offer search, price comparison and corpus analytics as Spark jobs."""
