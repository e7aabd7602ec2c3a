"""trajlake: robot demonstration data as Spark tables.

Layers (each imports only the ones above it):

* ``functions``  - Column expressions (text, planar and rigid motion, gripper, geometry); no UDFs
* ``operators``  - DataFrame -> DataFrame building blocks and domain operators
* ``sources``    - readers, writers and the projections that land raw tables in canonical form
* ``plans``      - named queries over the landed tables, each with its SQL check
* ``streaming``  - incremental versions of the record operators
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Grouped-map functions travel to executors with their helpers, so workers need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
