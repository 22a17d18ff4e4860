"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; the registry in
``orrery.llm.queries`` is what the repository's entry module picks up.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
