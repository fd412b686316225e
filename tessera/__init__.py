"""tessera: a Spark-native feature, sampling and evaluation engine for
wide recommendation tables (scalars, int arrays, dense vectors and
behaviour sequences).

Every operator is a DataFrame / Column expression; Python runs only
inside Arrow-batched ``mapInPandas`` helpers where a per-partition scan
is genuinely needed.
"""

from tessera.session import get_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
