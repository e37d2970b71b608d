"""What the engine raises."""


class RetrievalError(Exception):
    """Base of the engine's errors."""


class EmptyQueryError(RetrievalError):
    """A query without terms."""


class EmptyIndexError(RetrievalError):
    """An index without documents."""


class InvalidFuzzyConfigError(RetrievalError):
    """Fuzzy settings that cannot be used."""


class LogStateError(RetrievalError):
    """An operation log and its checkpoint that do not fit, or a log that cannot be read."""
