"""Rows of two engines in one form."""


def normal(frame):
    """Rows as sorted tuples of text, columns by name."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, row)) for row in frame.astype(object).values.tolist())
