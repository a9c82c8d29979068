"""Registered queries, their SQL counterparts and the table mappings they share."""
