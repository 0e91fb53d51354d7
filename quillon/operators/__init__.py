"""The operators of a model graph. Importing this registers all of them."""

from . import core, feature, neighbours, text  # noqa: F401
from .registry import OPERATORS, Value, operator  # noqa: F401
