"""terrascore: Spark-native scoring of sample-point tables.

Every operator takes and returns DataFrames, is parametrised by column
names, and keys rows by an explicit ``sample_id``.  Fitted operators are
split into ``fit_*`` (returns a small, bounded dict of statistics) and
``apply_*`` (a pure projection), so the same statistics can be reused on
a scoring table or a stream.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers (Arrow-batch tasks) are pickled with
# their code, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from terrascore.session import get_session  # noqa: E402

__all__ = ["get_session"]
__version__ = "0.1.0"
