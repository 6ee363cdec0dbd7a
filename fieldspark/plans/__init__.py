"""Registered queries: tables derived from the given ones, operators over them, and the same in SQL."""
