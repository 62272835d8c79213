import gzip

from loomvar.sources import tables

DDL = """CREATE TABLE `transcript` (
  `transcript_id` int(10) unsigned NOT NULL,
  `gene_id` int(10),
  `seq_region_id` bigint,
  `start` int(10),
  `end_pos` int(10),
  `strand` tinyint(2),
  `stable_id` varchar(128),
  `biotype` varchar(40),
  `score` double,
  PRIMARY KEY (`transcript_id`)
) ENGINE=MyISAM;
CREATE TABLE `other` (
  `x` varchar(3)
);
"""


def test_dump(spark, tmp_path):
    (tmp_path / "t.sql.gz").write_bytes(gzip.compress(DDL.encode()))
    (tmp_path / "t.txt").write_text('1\t7\t3\t10\t20\t-1\tT1\tprotein_coding\t\\N\n2\t\\N\t4\t5\t6\t1\tT"2\t\\N\t0.5\n')
    got = tables.read_dump_with_ddl(spark, str(tmp_path / "t.txt"), str(tmp_path / "t.sql.gz"), "transcript")
    assert [tuple(r) for r in got.orderBy("transcript_id").collect()] == [(1, 7, 3, 10, 20, -1, "T1", "protein_coding", None), (2, None, 4, 5, 6, 1, 'T"2', None, 0.5)]
    gene = tables.values(spark, [(7, "G7", "ALPHA")], "gene_id long, stable_id string, symbol string")
    region = tables.values(spark, [(3, "17", "chromosome"), (4, "KI27", "scaffold")], "seq_region_id long, name string, coord_system string")
    attribs = tables.values(spark, [(1, "is_canonical", "1"), (1, "TSL", "tsl1"), (1, "appris", "principal1"), (2, "MANE_Select", "x")], "transcript_id long, code string, value string")
    made = tables.assemble_transcripts(got, gene, region, attribs).collect()
    assert [(r.transcript_id, r.chrom, r.gene_symbol, r.canonical, r.mane_select, r.tsl, r.appris) for r in made] == [("T1", "17", "ALPHA", True, False, 1, "principal1")]


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "hits": [{"t": "T1", "n": 2}, {"t": "T2", "n": 3}]}\n{"id": 2, "hits": []}\n')
    schema = "id long, hits array<struct<t:string,n:long>>"
    assert sorted(map(tuple, tables.read_ndjson(spark, str(tmp_path / "a.json"), schema, "hits").collect())) == [(1, "T1", 2), (1, "T2", 3)]
    assert tables.read_ndjson(spark, str(tmp_path / "a.json"), schema).count() == 2


def test_sinks(spark, tmp_path):
    df = tables.values(spark, [(1, ["b", "a"]), (2, [])], "k long, terms array<string>")
    for kind in ("parquet", "json"):
        tables.write(df, str(tmp_path / kind), kind)
        assert sorted(map(str, spark.read.schema(df.schema).format(kind).load(str(tmp_path / kind)).collect())) == sorted(map(str, df.collect()))
    tables.write(df, str(tmp_path / "csv"), "csv")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("k").collect()][0] == ("1", "b&a")
    assert tables.save_table(df, "kept_rows").count() == 2
    spark.sql("DROP TABLE kept_rows")
