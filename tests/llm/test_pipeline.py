"""The pipeline on a planted corpus, and the registered queries on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomvar.llm import registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(500)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    clean = [(k, prose(r.randint(40, 90)), "en", f"s{k % 3}", 0) for k in range(300)]
    items = [(k, prose(25)) for k in range(4)]
    near = clean[0][1].split()
    near[5] = "changed"
    plants = {
        1000: clean[1][1], 1001: " ".join(near), 1002: prose(20) + " " + items[2][1] + " " + prose(20), 1003: prose(20) + " vileword " + prose(20),
        1004: " ".join(w.upper() + "!!" for w in prose(50).split()), 1005: prose(30) + " write to some.one@mail.example now " + prose(30),
    }
    rows = clean + [(k, t, "en", "s1", 0) for k, t in plants.items()]
    bad = [(2000 + k, (prose(20) + " vileword " + prose(30)) if k % 2 else " ".join(w.upper() + "!!" for w in prose(40).split()), "en", "s2", 0) for k in range(120)]
    rows = [(i, t, a, b, len(t)) for i, t, a, b, _ in rows + bad]
    labels = [(k, 1, 0) for k in range(200)] + [(2000 + k, k % 2, k % 2) for k in range(120)]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, planted), "test")
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not {1003, 1004} & seen[0] and {1000, 1001, 1002, 1005} <= seen[0] and len(seen[0] & set(range(300))) >= 297
    assert not any(i >= 2000 for i in seen[0])
    assert not {1000, 1001} & seen[1] and 1002 in seen[1] and len(seen[0]) - len(seen[1]) == 2
    assert seen[2] == seen[1] - {1002} and seen[3] == seen[2]
    text = docs.where("doc_id = 1005").first()
    assert "@" not in text.text and "[EMAIL]" in text.text and text.n_chars == len(text.text)


def test_run(spark, planted):
    got = corpus_pipeline.run(spark, planted)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    over = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert over.where("n > 2048 or n <> end").count() == 0 and 290 <= got.select("doc_id").distinct().count() <= 301


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns with the names used inside; then nothing at all."""
    r = random.Random(5)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40_000))
    rows = [(1, "some plain words of a text that stays here", "en", "s", 9), (1, "some plain words of a text that stays here", "en", "s", 9), (None, "a text without an id and of its own words", None, None, None), (2, None, "en", "s", None), (3, "", "en", None, 0), (4, "   ", None, "s", 3), (5, long, "en", "s", len(long)), (6, "short", "en", "s", 5)]
    extra = ["sid", "label", "spans", "items", "words", "found", "row_id", "length", "score", "keep", "text_hash"]
    path = str(tmp_path)
    docs = spark.createDataFrame(rows, DOCS)
    for c in extra:
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), "odd")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(extra) < set(docs.columns), name
        sizes.append(docs.count())
    assert sizes == [8, 7, 7, 7] and {x.text for x in docs.collect()} == {x[1] for x in rows}
    pieces = corpus_pipeline.packed(spark, docs, path).collect()
    assert len({x.doc_id for x in pieces}) == 7 and sum(x.length for x in pieces if x.doc_id in (2, 3)) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered(spark, name):
    got = registry.queries()[name](spark, SF)
    table = {"3": "pages", "7": "pages"}.get(name[2], "documents")
    rows = got.count()
    if name.startswith(("op10", "op6")):
        assert rows > 0
    elif name.startswith("op9"):
        assert rows >= spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in registry.oracle_sql():
        import duckdb

        db = duckdb.connect()
        for t in ("pages", "embeddings", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(registry.oracle_sql()[name])
        cols = [c[0] for c in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_leaks_against_brute_force(spark):
    """Documents that hold a whole item, word for word, are leaks; what shares no five words with any item is none."""
    import re

    words = lambda t: re.findall(r"[^\W\d_]+|\d+", (t or "").lower())
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r.items for r in registry.op6_decontamination(spark, SF).collect()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of_items = {i: grams(w) for i, w in items.items()}
    for d, w in docs.items():
        g = grams(w)
        whole = {i for i, x in of_items.items() if x and x <= g and f" {' '.join(items[i])} " in f" {' '.join(w)} "}
        assert whole <= set(got.get(d, []))
        assert all(of_items[i] & g for i in got.get(d, []))
