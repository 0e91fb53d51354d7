"""A Spark-native engine that scores declarative, already-trained model graphs."""

from .api import ScoringModel, Session  # noqa: F401
from .functions.expressions import GraphError, parse  # noqa: F401
from .plans import Graph, apply_graph  # noqa: F401
