import os

from loomvar import session
from loomvar.sources.model import GeneModel
from test_sources import fasta_path, gff_path  # noqa: F401

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_sql_surface(spark, gff_path, fasta_path, tmp_path):  # noqa: F811
    cache = str(tmp_path / "cache")
    assert session.load_cache(spark, gff_path, fasta_path[0], cache=cache) == "loaded"
    assert session.load_cache(spark, cache) == "loaded"
    session.view_vcf(spark, "calls", f"{DATA}/multi.vcf")
    assert spark.sql("SELECT count(*) FROM calls_samples").first()[0] == 3
    assert spark.sql("SELECT gt[0] FROM calls WHERE pos = 1000").first()[0] == "0|1"
    session.view_gff(spark, "genes", gff_path)
    assert spark.sql("SELECT count_if(coding) FROM genes").first()[0] == 2
    source = "SELECT '1' AS chrom, pos, end_pos, ref, alt FROM calls_variants"
    near = session.candidate_pairs(spark, source, cache)
    assert near.columns == ["chrom", "pos", "end_pos", "ref", "alt", "transcript_id", "gene_id", "gene_symbol", "biotype", "canonical"] and near.count() == 8
    spark.sql(source).createOrReplaceTempView("named")
    rows = session.annotate_table(spark, "named", cache)
    assert rows.count() == 8 and rows.where("size(consequence) = 0").count() == 0
    total = spark.sql(f"SELECT sum(size(vep_consequence(chrom, pos, end_pos, ref, alt))) FROM ({source})").first()[0]
    assert total == 8
    phased = f"SELECT *, 'S' AS sample_id, '1' AS phase_set, 1 AS haplotype FROM ({source})"
    assert session.haplotype_annotate(spark, phased, cache).count() == 2
    regions = "SELECT '1' AS chrom, 900L AS start, 1100L AS end_pos, 'r' AS name, 1.0D AS value"
    assert session.join_regions(spark, source, regions).where("region_annotations is not null").count() == 1
    points = "SELECT '1' AS chrom, 2000L AS pos, 'C' AS ref, 'A' AS alt, 5 AS hit"
    assert [r.hit for r in session.join_points(spark, source, points).where("hit is not null").collect()] == [5]
    assert GeneModel.load(spark, cache).transcripts().columns == ["transcript_id", "chrom", "start", "end_pos", "strand", "gene_id", "gene_symbol", "biotype", "canonical", "coding"]
