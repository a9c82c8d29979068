"""Pageloom: site-content analytics and retrieval as Spark DataFrame jobs."""
