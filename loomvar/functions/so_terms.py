"""The consequence vocabulary: term, impact and severity rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Terms by impact, each with its rank (1 is the most severe).
HIGH = {
    "transcript_ablation": 1, "splice_acceptor_variant": 2, "splice_donor_variant": 3, "stop_gained": 4, "frameshift_variant": 5,
    "stop_lost": 6, "start_lost": 7, "transcript_amplification": 8, "feature_elongation": 9, "feature_truncation": 10,
}
MODERATE = {"inframe_insertion": 11, "inframe_deletion": 12, "missense_variant": 13, "protein_altering_variant": 14, "TFBS_ablation": 34}
LOW = {
    "splice_donor_5th_base_variant": 15, "splice_region_variant": 16, "splice_donor_region_variant": 17, "splice_polypyrimidine_tract_variant": 18,
    "incomplete_terminal_codon_variant": 19, "start_retained_variant": 20, "stop_retained_variant": 21, "synonymous_variant": 22,
}
MODIFIER = {
    "coding_sequence_variant": 23, "mature_miRNA_variant": 24, "5_prime_UTR_variant": 25, "3_prime_UTR_variant": 26, "non_coding_transcript_exon_variant": 27,
    "intron_variant": 28, "NMD_transcript_variant": 29, "non_coding_transcript_variant": 30, "coding_transcript_variant": 31, "upstream_gene_variant": 32,
    "downstream_gene_variant": 33, "TFBS_amplification": 35, "TF_binding_site_variant": 36, "regulatory_region_ablation": 37, "regulatory_region_amplification": 38,
    "regulatory_region_variant": 39, "intergenic_variant": 40, "sequence_variant": 41,
}

RANK = HIGH | MODERATE | LOW | MODIFIER
IMPACT = {t: name for name, terms in (("HIGH", HIGH), ("MODERATE", MODERATE), ("LOW", LOW), ("MODIFIER", MODIFIER)) for t in terms}


def by_rank(terms) -> list[str]:
    """Distinct terms, most severe first."""
    return sorted(set(terms), key=lambda t: (RANK.get(t, 99), t))


def impact_of(terms) -> str:
    """Impact of the most severe term."""
    ranked = by_rank(terms)
    return IMPACT.get(ranked[0], "MODIFIER") if ranked else ""


def so_table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a dimension table (41 rows)."""
    return spark.createDataFrame([(t, IMPACT[t], r) for t, r in RANK.items()], "so_term string, impact string, rank int")
