"""Retrieval and governed analytics over many tables, as plain Spark jobs.

``sources``    reading and writing tables, the embedding store and the logs
``functions``  column expressions (text, time, JSON, vectors)
``operators``  DataFrame -> DataFrame steps
``streaming``  the append-only flows as Structured Streaming queries
``plans``      shared building blocks: scratch tables, row positions, size checks
``catalog``    the registered queries and their SQL counterparts
"""
