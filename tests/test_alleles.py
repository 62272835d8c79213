import random

import pytest
from pyspark.sql import functions as F

from loomvar.functions import alleles
from loomvar.functions.so_terms import IMPACT, RANK, by_rank, impact_of
from loomvar.operators.annotate import register_normalize


def model(pos, ref, alt):
    while len(ref) + len(alt) > 2 and ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while len(ref) + len(alt) > 2 and ref and alt and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def test_normalize(spark):
    r = random.Random(3)
    seq = lambda: "".join(r.choices("AC", k=r.randint(1, 6)))
    cases = [(100, "CT", "C"), (100, "C", "CA"), (100, "A", "G"), (100, "AT", "GC"), (100, "CTG", "CG"), (5, "A", "A")] + [(r.randint(1, 99), seq(), seq()) for _ in range(500)]
    want = [model(*c) for c in cases]
    assert want[:5] == [(101, "T", ""), (101, "", "A"), (100, "A", "G"), (100, "AT", "GC"), (101, "T", "")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, pos long, ref string, alt string")
    got = df.select("k", alleles.normalize_variant(F.col("pos"), F.col("ref"), F.col("alt")).alias("n")).orderBy("k").collect()
    assert [tuple(r["n"]) for r in got] == want
    register_normalize(spark)
    df.createOrReplaceTempView("cases")
    got = spark.sql("SELECT k, normalize_variant(pos, ref, alt) AS n FROM cases ORDER BY k").collect()
    assert [tuple(r["n"]) for r in got] == want


def test_normalize_nulls(spark):
    df = spark.createDataFrame([(1, None, "A"), (None, "A", "C")], "pos long, ref string, alt string")
    assert [r[0] for r in df.select(alleles.normalize_variant(F.col("pos"), F.col("ref"), F.col("alt"))).collect()] == [None, None]


def test_end_and_kinds(spark):
    rows = [(10, "ACG", "."), (10, "N", "XEND=9;END=50"), (10, "N", "SVTYPE=DEL;SVLEN=-5,7"), (10, "N", "SVLEN=5;SVTYPE=INS"), (10, "N", "END=.;SVLEN=4")]
    df = spark.createDataFrame(rows, "pos long, ref string, info string")
    assert [r[0] for r in df.select(alleles.compute_end(F.col("pos"), F.col("ref"), F.col("info"))).collect()] == [12, 50, 15, 10, 14]
    alts = ["<DEL>", "<dup:tandem>", "<CN1>", "<CN2>", "<CN3>", "]1:5]A", "<INS>", "ACG", "<WHAT>", None]
    df = spark.createDataFrame([(a,) for a in alts], "alt string")
    assert [r[0] for r in df.select(alleles.sv_type(F.col("alt"))).collect()] == ["deletion", "tandem_duplication", "copy_number_loss", "copy_number_variation", "copy_number_gain", "breakend", "insertion", None, "unknown", None]


def test_region_text():
    assert alleles.parse_region("chr2:1,000-2,000") == ("2", 1000, 2000)
    assert alleles.parse_region("X") == ("X", None, None)
    for bad in ("chr1:1OO-2OO", "chr1:100", "1:a-b", "1:"):
        with pytest.raises(ValueError, match="invalid region"):
            alleles.parse_region(bad)


def test_small_expressions(spark):
    df = spark.createDataFrame([("ATG", "chrM"), ("TGA", "2"), ("NAA", "Chr3")], "c string, chrom string")
    got = df.select(alleles.amino_acid(F.col("c")), alleles.revcomp(F.col("c")), alleles.chrom_alias(F.col("chrom"))).collect()
    assert [tuple(r) for r in got] == [("M", "CAT", "MT"), ("*", "TCA", "2"), ("X", "TTN", "3")]


def test_vocabulary():
    assert len(RANK) == len(IMPACT) == 41 and sorted(RANK.values()) == list(range(1, 42))
    assert by_rank(["intron_variant", "stop_gained", "stop_gained"]) == ["stop_gained", "intron_variant"]
    assert impact_of(["intron_variant", "splice_region_variant"]) == "LOW"
