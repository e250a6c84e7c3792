"""Grid filters against a direct reading of their rules, on random rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shipfold.operators import filters as FL

ALPHA = st.sampled_from(list("ab-: 019XÉé_%"))
TEXT = st.one_of(st.none(), st.text(ALPHA, max_size=6))
DATE = st.one_of(st.none(), st.just(""), st.sampled_from(
    ["2030-01-05", "2030-01-05 08:00:00", "2030-01-06 23:59:00", "2030-01-04 23:59:59", "2031"]))


def matches(row, filters):
    """The rules as documented: NULL is ''; a range is lexical with the upper
    bound extended by U+FFFF; anything else is a case-insensitive substring."""
    for key, want in filters.items():
        have = "" if row[key] is None else row[key]
        if isinstance(want, dict):
            if want["start"] and have < want["start"]:
                return False
            if want["end"] and have > want["end"] + "￿":
                return False
        elif want.lower() not in have.lower():
            return False
    return True


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(TEXT, DATE), min_size=1, max_size=25),
       needle=st.text(ALPHA, min_size=1, max_size=2),
       start=st.sampled_from(["", "2030-01-05", "2030-01-06"]),
       end=st.sampled_from(["", "2030-01-05", "2030-01-06"]))
def test_grid_filter_matches_rules(spark, rows, needle, start, end):
    data = [(i, t, d) for i, (t, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, t string, eta string")
    filters = {"t": needle}
    if start or end:
        filters["eta"] = {"start": start, "end": end}
    got = sorted(r["id"] for r in FL.grid_filter(df, filters).collect())
    # The grid trims text filters and ignores empty ones.
    rules = dict(filters)
    rules.pop("t")
    if needle.strip():
        rules["t"] = needle.strip()
    want = sorted(i for i, t, d in data if matches({"t": t, "eta": d}, rules))
    assert got == want
