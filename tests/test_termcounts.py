"""Terms counted without pairs, against the annotated pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomvar.operators import annotate, codoncounts
from loomvar.sources.model import GeneModel

VARIANTS = "chrom string, pos long, end_pos long, ref string, alt string"
MODEL = """tx_idx long, transcript_id string, chrom string, start long, end_pos long, strand long, coding boolean, exons array<struct<start:long,end:long>>, cds_start long, cds_end long, biotype string,
 gene_id string, gene_symbol string, canonical boolean, version int, spliced string, protein_id string, protein_version int, cds_phase int, flags array<string>"""


def bases(r, n):
    return "".join(r.choices("ACGT", k=n))


@pytest.fixture(scope="module")
def variants(spark):
    r, rows = random.Random(3), []
    for _ in range(6000):
        pos = r.choice((r.randint(1, 40_000), 16_384 + r.randint(-3, 3)))
        ref, alt = bases(r, r.choice((1, 1, 2, 3, 4, 9))), r.choice((bases(r, r.choice((1, 1, 2, 3, 4, 7))), bases(r, 1), "<DEL>" if r.random() < 0.02 else "A"))
        rows.append((r.choice("12"), pos, pos + r.choice((0, 0, 3, 900)), ref, alt))
    rows += [rows[0]] * 50 + [("1", 500, 500, "C", "C"), (None, 5, 5, "A", "C"), ("1", None, 5, "A", "C"), ("1", 2_000, 2_000, bases(r, 90), "A"), ("1", 3_000, 3_000, "A", None), ("2", 4_000, 3_000, "a", "g")]
    return spark.createDataFrame(rows, VARIANTS).repartition(3)


def transcripts(spark, known: bool):
    r, rows = random.Random(4), []
    for k in range(90):
        at, exons = r.randint(1, 36_000), []
        for _ in range(r.choice((1, 2, 4, 5))):
            exons.append((at, at + r.choice((1, 29, 90, 600))))
            at = exons[-1][1] + r.choice((9 if k % 9 == 0 else 14, 14, 40, 500, 2_000))
        coding, one = r.random() < 0.7, r.choice((1, -1))
        spliced = bases(r, sum(b - a + 1 for a, b in exons)) if known and coding and k % 5 else None
        inside = (exons[0][0] + r.choice((0, 1)), exons[-1][1] - r.choice((0, 1))) if coding else (None, None)
        if spliced and k % 3 == 0:
            at = inside[0] - exons[0][0] if one > 0 else exons[-1][1] - inside[1]
            spliced = spliced[:at] + "ATG" + spliced[at + 3 :] if len(spliced) > 9 else spliced
        rows.append((k, f"T{k}", r.choice("12"), exons[0][0], exons[-1][1], one, coding, exons, *inside, r.choice(("a", "nonsense_mediated_decay")), f"G{k}", "", False, None, spliced, "P", 1, k % 17 == 3 and 1 or 0, ["cds_start_NF"] if k % 13 == 5 else []))
    rows.append((999, "T999", "1", 100, 9_000, 1, False, [], None, None, "a", "G", "", False, None, None, None, None, 0, []))
    return GeneModel(spark.createDataFrame(rows, MODEL))


@pytest.mark.parametrize("known", (False, True))
def test_term_counts(spark, variants, known):
    model = transcripts(spark, known)
    want = Counter((t, r.impact) for r in annotate.annotate(variants, model, hgvs=False).select("consequence", "impact").collect() for t in r.consequence)
    got = {(r.term, r.impact): r.n for r in annotate.term_counts(variants, model).collect()}
    assert got == want and len(want) > 25


def test_term_counts_make_no_pairs(spark, variants):
    """Plain variants beside plain transcripts are not joined: counts of a thousand times as many rows cost no pair."""
    model = transcripts(spark, False)
    plain = GeneModel(model.table.where("tx_idx % 9 <> 0 and tx_idx <> 999"))
    snv = variants.where("length(ref) = 1 and alt in ('A', 'C', 'G', 'T') and end_pos - pos < 9")
    many = snv.crossJoin(spark.range(1000)).drop("id")
    once = {(r.term, r.impact): 1000 * r.n for r in annotate.term_counts(snv, plain).collect()}
    assert {(r.term, r.impact): r.n for r in annotate.term_counts(many, plain).collect()} == once and once
    assert "Join" not in annotate.term_counts(snv, plain)._jdf.queryExecution().optimizedPlan().toString()


def test_coding_counts(spark, variants):
    model = transcripts(spark, True)
    near = F.explode(F.concat(F.sequence("start", F.col("start") + 5), F.sequence(F.col("end_pos") - 5, "end_pos")))
    ends = model.table.select("chrom", near.alias("pos")).select("chrom", "pos", F.col("pos").alias("end_pos"), F.lit("N").alias("ref"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("alt"))
    variants = variants.unionByName(ends)
    rows = [r for r in annotate.annotate(variants, model, hgvs=False).collect()]
    want = {}
    for r in rows:
        for t in set(r.consequence) & set(annotate.CODING_TERMS):
            n, places = want.get((t, r.amino_acids), (0, None))
            want[t, r.amino_acids] = n + 1, places if r.protein_pos is None else (places or 0) + r.protein_pos
    assert {(r.term, r.amino_acids): (r.n, r.places) for r in annotate.coding_counts(variants, model).collect()} == want
    assert {t for t, _ in want} >= {"missense_variant", "synonymous_variant", "stop_gained", "stop_lost", "start_lost", "incomplete_terminal_codon_variant"}
    assert "Join" not in codoncounts.effect_counts(annotate.prepared(variants).where(codoncounts.single()), model.table.where(codoncounts.readable()))._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark, variants):
    model = transcripts(spark, False)
    assert not annotate.term_counts(variants.limit(0), model).count() and not annotate.term_counts(variants, GeneModel(model.table.limit(0))).count()
