"""The two ways in which a query is refused."""


class QueryError(Exception):
    """Base of both."""


class UnsupportedError(QueryError):
    """The construct is outside the supported subset."""


class InvalidQueryError(QueryError):
    """The construct is supported, but not like this."""


class UnsupportedVerb(UnsupportedError, AttributeError):
    """A verb that the engine refuses by design."""
