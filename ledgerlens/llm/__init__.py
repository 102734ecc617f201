"""Training-data operators (deduplication, filtering, mixing, packing, ...).

Nothing else in the package imports this folder; ``llm.queries`` registers
one query per operator and ``corpus_pipeline.py`` chains five of them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# tasks carry the functions of this folder themselves: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
