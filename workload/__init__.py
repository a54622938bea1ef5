"""Registered queries over the driver tables, with reference SQL for each."""
