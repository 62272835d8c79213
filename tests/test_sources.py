import gzip
import os

import pytest
from pyspark.sql import functions as F

from loomvar.sources import fasta, gff, vcf
from loomvar.sources.model import GeneModel

DATA = os.path.join(os.path.dirname(__file__), "data")
GFF = """##gff-version 3
1\tx\tgene\t1001\t1600\t.\t+\t.\tID=gene:G1;Name=ALPHA;biotype=protein_coding
1\tx\tmRNA\t1001\t1600\t.\t+\t.\tID=transcript:T1;Parent=gene:G1;biotype=protein_coding;tag=basic,Ensembl_canonical;transcript_support_level=1 (assigned);version=2
1\tx\tmRNA\t1001\t1600\t.\t+\t.\tID=transcript:T1;Parent=gene:G1;biotype=protein_coding;tag=basic,Ensembl_canonical;transcript_support_level=1 (assigned);version=2
1\tx\texon\t1001\t1100\t.\t+\t.\tParent=transcript:T1;rank=1
1\tx\texon\t1301\t1400\t.\t+\t.\tParent=transcript:T1;rank=2
1\tx\texon\t1501\t1600\t.\t+\t.\tParent=transcript:T1;rank=3
1\tx\tCDS\t1051\t1100\t.\t+\t0\tID=CDS:P1;Parent=transcript:T1;protein_id=P1;version=3
1\tx\tCDS\t1301\t1400\t.\t+\t1\tID=CDS:P1;Parent=transcript:T1;protein_id=P1;version=3
1\tx\tgene\t5001\t5600\t.\t-\t.\tID=gene:G2;Name=BE%20TA;biotype=lncRNA
1\tx\tlnc_RNA\t5001\t5600\t.\t-\t.\tID=transcript:T2;Parent=gene:G2;biotype=lncRNA
1\tx\texon\t5001\t5100\t.\t-\t.\tParent=transcript:T2
1\tx\texon\t5301\t5600\t.\t-\t.\tParent=transcript:T2
2\tx\tgene\t101\t160\t.\t-\t.\tID=gene:G3;Name=GAMMA;biotype=protein_coding
2\tx\tmRNA\t101\t160\t.\t-\t.\tID=transcript:T3;Parent=gene:G3;biotype=protein_coding
2\tx\texon\t101\t160\t.\t-\t.\tParent=transcript:T3
2\tx\tCDS\t110\t139\t.\t-\t0\tID=CDS:P3;Parent=transcript:T3;protein_id=P3
"""


@pytest.fixture(scope="session")
def gff_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("gff") / "model.gff3"
    path.write_text(GFF)
    return str(path)


@pytest.fixture(scope="session")
def fasta_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("fa") / "ref.fa"
    one = "".join("ACGT"[(k * k + k // 3) % 4] for k in range(6000))
    two = "".join("ACGT"[(k * 7 + k // 5) % 4] for k in range(300))
    path.write_text(">1 first\n" + "\n".join(one[k : k + 60] for k in range(0, 6000, 60)) + "\n>2\n" + two + "\n")
    return str(path), {"1": one, "2": two}


def test_vcf_rows(spark):
    rows = vcf.read_vcf(spark, f"{DATA}/multi.vcf").orderBy("pos").collect()
    assert [(r.pos, r.end_pos, r.alt, r.qual, r.filter, r.gt) for r in rows] == [
        (1000, 1000, ["G"], 50.0, ["PASS"], ["0|1", "1/1", "0|0"]),
        (2000, 2000, ["T", "A"], None, ["q10", "low"], ["1|2", "0/1", "./."]),
        (3000, 3000, ["T"], 9.5, [], [".", ".", "."]),
    ]
    assert [tuple(r) for r in vcf.vcf_samples(spark, f"{DATA}/multi.vcf").orderBy("idx").collect()] == [(1, "S1"), (2, "S2"), (3, "S3")]


def test_vcf_spans_and_regions(spark):
    path = f"{DATA}/structural.vcf"
    rows = {r.pos: r for r in vcf.read_vcf(spark, path).collect()}
    assert {p: r.end_pos for p, r in rows.items()} == {1000: 1000, 5000: 8000, 9000: 9000, 12000: 20000, 25000: 25500, 26000: 26000}
    assert rows[1000].gt == [] and rows[5000].filter == ["q10", "lowqual"] and rows[5000].qual is None
    assert sorted(r.pos for r in vcf.read_vcf(spark, path, "chr1:4000-13000").collect()) == [5000, 9000, 12000]
    assert [r.pos for r in vcf.read_vcf(spark, path, "chr1:25,200-25,300").collect()] == [25000]
    assert vcf.read_vcf(spark, path, "1").count() == 6
    with pytest.raises(ValueError, match="invalid region"):
        vcf.read_vcf(spark, path, "chr1:1OO-2OO")
    assert vcf.variants_from_vcf(spark, path).count() == 8


def test_gzip_by_content(spark, tmp_path):
    whole = open(f"{DATA}/multi.vcf").read()
    for name in ("a.vcf.gz", "b.vcf.bgz", "c.bin"):
        cut = whole.index("chr1\t2000")
        (tmp_path / name).write_bytes(gzip.compress(whole[:cut].encode()) + gzip.compress(whole[cut:].encode()))
        assert vcf.read_vcf(spark, str(tmp_path / name)).count() == 3, name


def test_bad_position_is_an_error(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\tabc\t.\tA\tC\t.\t.\t.\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|abc"):
        vcf.read_vcf(spark, str(tmp_path / "x.vcf")).collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.vcf").write_text("")
    assert vcf.read_vcf(spark, str(tmp_path / "e.vcf")).count() == 0


def test_phased(spark):
    path = f"{DATA}/multi.vcf"
    rows = vcf.phased_variants(vcf.read_vcf(spark, path), vcf.vcf_samples(spark, path)).collect()
    assert sorted((r.sample_id, r.pos, r.alt, r.haplotype) for r in rows) == [("S1", 1000, "G", 2), ("S1", 2000, "A", 2), ("S1", 2000, "T", 1)]


def test_gene_model(spark, gff_path):
    rows = {r.transcript_id: r for r in gff.read_gff_transcripts(spark, gff_path).collect()}
    assert set(rows) == {"T1", "T2", "T3"}
    t1 = rows["T1"]
    assert (t1.chrom, t1.start, t1.end_pos, t1.strand, t1.gene_id, t1.gene_symbol, t1.canonical, t1.coding, t1.tsl) == ("1", 1001, 1600, 1, "G1", "ALPHA", True, True, 1)
    assert (rows["T2"].coding, rows["T2"].gene_symbol, rows["T2"].strand, rows["T2"].tsl) == (False, "BE TA", -1, None)


def test_model_views_and_sequence(spark, gff_path, fasta_path):
    path, seq = fasta_path
    m = GeneModel.load(spark, gff_path, path)
    assert [r.transcript_id for r in m.table.orderBy("tx_idx").collect()] == ["T1", "T2", "T3"]
    assert m.exons().count() == 6
    cds = {r.tx_idx: r.cds_seq for r in m.cds_seq().collect()}
    assert cds[0] == seq["1"][1050:1100] + seq["1"][1300:1400]
    back = str.maketrans("ACGT", "TGCA")
    assert cds[2] == seq["2"][109:139].translate(back)[::-1]
    assert m.register(spark) == "loaded"
    assert spark.sql("SELECT count(*) FROM vep_exons WHERE cds_start = 0").first()[0] == 2


def test_cache(spark, gff_path, tmp_path):
    cache = str(tmp_path / "cache")
    a = GeneModel.load(spark, gff_path, cache=cache)
    b = GeneModel.load(spark, cache)
    assert sorted(map(str, a.table.collect())) == sorted(map(str, b.table.collect()))
    os.utime(gff_path)
    assert GeneModel.load(spark, gff_path, cache=cache, zstd=99, distance=-5).distance == 0


def test_fasta_chunks(spark, fasta_path):
    path, seq = fasta_path
    rows = fasta.read_fasta(spark, path, 1000).orderBy("chrom", "chunk").collect()
    assert "".join(r.bases for r in rows if r.chrom == "1") == seq["1"] and len(rows) == 7


def test_bed(spark, tmp_path):
    (tmp_path / "t.bed").write_text("track name=x\nchr1\t0\t10\ta\t1.5\nchr1\t20\t30\n")
    assert [tuple(r) for r in gff.read_bed(spark, str(tmp_path / "t.bed")).collect()] == [("chr1", 1, 10, "a", 1.5), ("chr1", 21, 30, None, None)]


def test_clashing_columns(spark):
    sites = vcf.read_vcf(spark, f"{DATA}/multi.vcf").withColumn("c", F.lit(1))
    assert vcf.variants_from_sites(sites).count() == 4
