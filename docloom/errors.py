class UnsupportedWildcardError(ValueError):
    """A wildcard query with more than one `*`."""


class InvalidRangeError(ValueError):
    """A date range that ends before it starts."""
