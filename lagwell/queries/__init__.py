"""Registered queries: each applies an operator to the shared views, beside the SQL that defines its result."""
