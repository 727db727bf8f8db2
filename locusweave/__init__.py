"""locusweave: discovery of genomic loci that share multi-mapping reads, as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  The alignment contract is
described in :mod:`locusweave.schema`; read sets are always normalised relations
(``locus_id, read_id``), never array columns.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so workers need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
