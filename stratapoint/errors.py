"""Errors by role."""


class StratapointError(Exception):
    """Base of all errors of this package."""


class InvalidContent(StratapointError, ValueError):
    """Bytes or arrays that are no valid tile content."""


class InvalidPoints(InvalidContent):
    """A points content with wrong lengths, kinds or fields."""


class InvalidBatchedModel(InvalidContent):
    """A batched model content with wrong lengths."""


class InvalidTileset(StratapointError, ValueError):
    """A tileset description that lacks what it needs."""


class BoxMissing(InvalidTileset):
    """A tile without bounding volume."""


class UnknownExtension(StratapointError, KeyError):
    """An extension nobody registered, where one is required."""


class FormatNotSupported(StratapointError, ValueError):
    """No reader for a file's suffix or layout."""


class NoTilerFound(FormatNotSupported):
    """Files that no tiler takes; lists all of them."""


class MissingCrs(StratapointError, ValueError):
    """A target system without a source system."""


class MixedCrs(StratapointError, ValueError):
    """Input files in several systems."""


class TilingFailed(StratapointError, RuntimeError):
    """The points written differ from the points read."""


class InvalidIfc(FormatNotSupported):
    """A building file without exactly one project."""


class InvalidMetadata(StratapointError, ValueError):
    """A metadata schema that contradicts itself."""
