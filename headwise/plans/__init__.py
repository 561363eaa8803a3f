"""Serving queries, decision cards, reports and the batch job."""
