"""dealtrace: account-marketing analytics as Spark DataFrame operators.

Sub-packages: ``functions`` (Column expressions), ``sources`` (table schemas,
scans and sinks), ``operators`` (DataFrame building blocks), ``plans`` (the
analyses built from them) and ``catalog`` (the registered queries).
"""

__version__ = "0.1.0"
