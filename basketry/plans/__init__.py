"""Registered queries over the retail tables and their SQL counterparts."""
