"""Page corpus to Markdown mirror, as Spark jobs."""

import sys

from pyspark import cloudpickle

from mirrorleaf.config import MirrorConfig

# Executors get the helpers inside the plan, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MirrorConfig"]
