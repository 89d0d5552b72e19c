"""The pipeline on a small table: each stage's decisions, and the last one's packing."""

import re
import shutil

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import registry, stages

from ..conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    for t in ("benchmark", "labels"):
        shutil.copy(f"{SMALL}/{t}.parquet", d)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    text = " ".join(f"stone{k} river{k} light{k}" for k in range(40))
    more = spark.createDataFrame(
        [(9001, text, "en", "s", 1), (9002, text + " extra", "en", "s", 1), (9003, "start " + item, "en", "s", 1), (9004, "write to bob.7@mail.example.com today please", "en", "s", 1), (9005, None, None, None, None), (9006, "", "en", "s", 0)],
        docs.schema,
    )
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = stage(spark, kept, folder).cache()
        after = {r.doc_id for r in kept.collect()}
        assert kept.columns == docs.columns and after <= before
        if name == "near_duplicates":
            assert 9001 in after and 9002 not in after
        if name == "decontamination":
            assert 9003 not in after
        assert {9005, 9006} & before <= after | ({9006} if name == "near_duplicates" else set())
    assert {r.doc_id: r.text for r in kept.collect()}[9004] == "write to <email> today please"
    sizes = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sizes and max(sizes.values()) <= 2048


def test_rows_are_judged_by_themselves(spark, folder):
    """Null ids, one id for several texts, repeated rows, clashing column names, very long texts: brute force over rows."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    a = " ".join(f"stone{k} river{k}" for k in range(60))
    b = " ".join(f"light{k} paper{k}" for k in range(60))
    rows = [(8, a), (8, a), (None, a), (9, a + " end"), (8, b), (None, b), (None, "see " + item), (8, "see " + item), (None, None), (None, None), (3, ""), (None, "word " * 40_000), (4, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, c0 string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, folder).collect()), key=repr)
    assert kept == sorted([(8, a), (8, b), (8, "see " + item), (None, None), (None, None), (3, ""), (None, "word " * 40_000), (4, "short text")], key=repr)
    clean = stages.drop_contaminated(spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in clean.where("text is not null and doc_id is not null").collect()) == sorted((i, t) for i, t in rows if i is not None and t is not None and item not in t)
    assert clean.count() == len(rows) - 2
    toxic = stages.drop_toxic(spark, docs, folder)
    assert toxic.columns == docs.columns and toxic.count() == len(rows)
    assert stages.redact_pii(spark, docs, folder).count() == len(rows)
    assert stages.pack_sequences(spark, docs, folder).where("piece = 0").count() == len(rows)


def test_near_duplicates_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, folder).collect()} == {i for i in sets if find(i) == i}


def test_empty_tables(spark, folder, tmp_path):
    for t in ("benchmark", "labels"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path)
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_registered_names():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SMALL)
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall())
