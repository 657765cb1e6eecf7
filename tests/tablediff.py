"""Comparison of results whatever the order of rows."""


def rows_of(frame):
    """A pandas frame as sorted tuples, columns by name, floats to six decimals."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False, name=None))
