"""Helpers of the tests of this folder."""


def key(row):
    """Sorts rows that may hold nulls."""
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
