"""Registered queries over the test tables, each with the SQL it must agree with."""
