"""Compositions, reports, registered queries and the SQL that checks them."""
