"""Training-data operators: dedup, tokenizers, filters, scans, sharding.

Nothing outside this package imports it.  Executors need the package on their
Python path, as for any library used in Python UDFs.
"""
