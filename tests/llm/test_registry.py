"""The registered queries against their SQL, and the pipeline against its stages done plainly."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from basaltine.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline(spark, duck, tokenizers):
    import sentencepiece

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "ids"]
    rows = out.collect()
    # the stages, plainly
    passed = duck.execute(f"SELECT doc_id FROM ({registry.ORACLES['op4_quality_rules']}) WHERE kept").fetchall()
    duck.execute("CREATE TABLE p AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [[p[0] for p in passed]])
    duck.execute(f"CREATE TABLE e AS SELECT * FROM p WHERE doc_id IN (SELECT doc_id FROM ({registry.ORACLES['op8_exact_dedup'].replace('FROM documents', 'FROM p')}) WHERE kept)")
    from test_methods import groups, slow_fingerprint

    fp = {i: slow_fingerprint(t) for i, t in duck.execute("SELECT doc_id, text FROM e").fetchall()}
    ids = sorted(fp)
    component = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3])
    duck.execute("CREATE TABLE n AS SELECT * FROM e WHERE doc_id IN (SELECT unnest(?))", [[i for i in ids if component[i] == i]])
    mixed = duck.execute(registry.ORACLES["op6_source_mix"].replace("FROM documents", "FROM n")).df()
    want = {r.doc_id: round(r.taken / r.size) for r in mixed.itertuples() if r.size and r.taken}
    got: dict[int, int] = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers[1])
    assert all(r["ids"] == library.encode(r["text"]) for r in rows)
