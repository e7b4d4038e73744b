"""Scalar column expressions (JVM built-ins only)."""

from tillroll.functions.dates import (  # noqa: F401
    day, elapsed_days, month_diff, month_index, month_start, week_end_label, week_start,
)
from tillroll.functions.numeric import (  # noqa: F401
    AMOUNT_PATTERN, dbl, growth_pct, parse_amount, pct_change, ratio, round_even, share_pct,
    sig_round,
)
