"""Property tests: Spark expressions against plain-Python restatements."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.functions import parse_amount
from tillroll.functions.numeric import AMOUNT_PATTERN

PIECES = ["", "$", "£", "€", "-", "(", ")", "EUR", " ", ",", ".", "e", "E", "+", "abc"]


def reference_parse(text: str):
    compact = re.sub(r"[,\s]", "", text)
    m = re.match(AMOUNT_PATTERN, compact)
    if not m:
        return None
    try:
        value = float(m.group(2))
    except ValueError:
        return None
    sign = -1.0 if ("-" in m.group(1) or "(" in m.group(1)) else 1.0
    return value * sign


amount_text = st.lists(
    st.one_of(st.sampled_from(PIECES), st.integers(0, 99999).map(str)),
    min_size=1, max_size=6).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(amount_text, min_size=200, max_size=200))
def test_parse_amount_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", parse_amount("t")).collect()}
    for i, t in enumerate(texts):
        want = reference_parse(t)
        assert got[i] == want, (t, got[i], want)
