"""Millrace: code and corpus analytics written as Spark DataFrame jobs."""
