"""Model graphs as declarations, and their compilation to one Spark plan without a shuffle."""

from .compile import apply_graph, reshape_rows, to_sparse  # noqa: F401
from .spec import Feature, Graph, Input, Node, Output  # noqa: F401
