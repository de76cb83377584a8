"""What can be wrong with a dictionary or a query."""


class BuildError(ValueError):
    """The dictionary can't be built."""


class EmptyTermError(BuildError):
    """A term is empty, or nothing is left of it when it is normalised."""


class QueryError(ValueError):
    """The query can't be searched."""


class QueryTooLongError(QueryError):
    """A query has more than 128 code points."""


class BudgetTooLargeError(QueryError):
    """A budget is over eight times the cheapest insertion or deletion."""
