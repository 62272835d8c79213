"""Names of regions over variants, against plain Python."""

import random
from collections import Counter

from loomvar.operators import regionlists


def test_region_names(spark):
    r = random.Random(3)
    variants = [(r.choice("12"), p := r.randint(1, 50_000), p + r.choice((0, 0, 4, 1_024, 1_025, 30_000)), r.choice("ACGT"), r.choice(["A", None, "CC"])) for _ in range(600)]
    variants += [variants[0]] * 40 + [("1", 16_384, 16_390, "A", "C"), ("1", 16_383, 16_384, "A", "C"), ("9", 5, 5, "A", "C"), (None, 5, 5, "A", "C"), ("1", None, None, "A", "C")]
    regions = [(r.choice("12"), s := r.randint(-20, 50_000), s + r.choice((0, 50, 700, 20_000, 1_200_000)), r.choice(["b", "a", "a", "é", None, ""]), 1.0) for _ in range(200)]
    want = {}
    for v, times in Counter(variants).items():
        names = sorted(f"{n}@{s}".encode() for c, s, e, n, _ in regions if n is not None and v[0] == c and v[1] is not None and s <= v[2] and e >= v[1] for _ in range(times))
        want[v] = (len(names), b"&".join(names).decode() if names else None)
    v = spark.createDataFrame(variants, "chrom string, pos long, end_pos long, ref string, alt string").repartition(3)
    t = spark.createDataFrame(regions, "chrom string, start long, end_pos long, name string, value double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("7", old):  # runs of equal variants go over the ends of batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = regionlists.region_names(v, t).collect()
            assert len(got) == len(want)
            assert {tuple(x)[:5]: (x.n_regions, x.names) for x in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    none = regionlists.region_names(v, t.limit(0)).collect()
    assert len(none) == len(want) and all(x.n_regions == 0 and x.names is None for x in none)
