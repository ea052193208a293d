"""glyphloom: tokenization analytics as Spark jobs.

A corpus is a DataFrame ``(split, doc_id, text)``.  Tokenizers are trained on it,
encode it to id arrays, lay the ids out as one stream per split, and count-based
next-token models score each tokenization.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
