"""ledgerlens: loan-tape analytics on Spark DataFrames.

Every public function takes and returns lazy ``DataFrame`` objects built
from built-in expressions, so Catalyst sees one plan per analysis.
"""

__version__ = "0.1.0"
