"""Near pairs first gives the divisions that all pairs give; counts by tile equal counts of single proposals."""

from tracewright.plans import divisions

SF = "/root/testdata/sf0.001"


def test_near_pairs_first(spark):
    """A small cap is filled by near pairs alone; the cap of the query needs several radii."""
    whole = sorted(tuple(r) for r in divisions.accepted_divisions(spark, SF, most=5).collect())
    part = sorted(tuple(r) for r in divisions.accepted_divisions(spark, SF, most=5, many=0).collect())
    assert len(whole) == 10 and part == whole
