"""Joins, aggregations and graph jobs over drawers, rooms, triples and vectors."""
