"""What tests of several modules use."""


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def close(got, want, rel=1e-9, least=1e-12):
    """Equal lists of numbers, nulls and other values, but for rounding."""
    same = lambda a, b: abs(a - b) <= max(least, rel * abs(b)) if isinstance(a, float) and isinstance(b, float | int) else a == b
    return len(got) == len(want) and all(same(a, b) for a, b in zip(got, want, strict=True))
