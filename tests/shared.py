"""Constants and helpers shared by the tests.  Test modules import this file,
never a ``conftest``: several folders have one, and only one wins."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Sorted list of tuples (selected columns), for order-free comparison."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
