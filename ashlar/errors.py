"""What can go wrong outside Spark's own analysis."""


class EngineError(Exception):
    """Any failure of this engine."""


class SourceError(EngineError):
    """A source that cannot be found, told or opened."""


class FormatError(SourceError):
    """A file that is not what it should be."""


class UnsupportedError(EngineError):
    """Something that is understood and refused."""


class DialectError(EngineError):
    """SQL text that the dialect cannot rewrite."""
