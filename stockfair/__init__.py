"""stockfair: Spark data jobs for retail stock and trade-fair sales.

Subpackages: ``functions`` (column functions), ``sources`` (readers, driver
views, sinks), ``operators`` (the jobs), ``plans`` (jobs wired end to end and
the registered queries), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
