"""Tessera: Spark operators for timed, vector-valued and graph-shaped tables."""
