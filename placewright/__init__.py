"""placewright: matching people to postings as Spark DataFrame plans.

Sub-packages
------------
functions   column expressions (text cleaning, compatibility rules, metadata)
operators   DataFrame -> DataFrame building blocks
sources     landed payloads, resume files, append-only tables, file sinks
plans       several operators put together (match, ingest, extract, screen)
streaming   the incremental versions of ingest and status folding
catalog     the registered queries over the test tables and their SQL checks
"""

__version__ = "0.1.0"
