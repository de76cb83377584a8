"""Typo-tolerant top-k search over weighted dictionaries, as Spark plans."""

from .api import Index
from .errors import BudgetTooLargeError, BuildError, EmptyTermError, QueryError, QueryTooLongError
from .functions.costs import CostModel
from .functions.layout import LAYOUTS
from .operators.search import SearchConfig

__all__ = ["LAYOUTS", "BudgetTooLargeError", "BuildError", "CostModel", "EmptyTermError", "Index", "QueryError", "QueryTooLongError", "SearchConfig"]
