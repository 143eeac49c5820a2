"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from basaltine.llm import chat, exact_dedup, license_scan, mixing, pieces, pipeline, quality_rules, simhash, surrogates, token_counts, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, kept boolean, failed long, ids string, score string, count long"
#: Names that operators use inside, and names of results.
INNER = """__row __text d t m p h i s x w u c id k0 k1 k2 h0 h1 h2 h3 raws parts news at lead value kind kinds canon gender title surrogate n_entities words windows pairs places lines
n_words word_chars n_symbols start first share license size copies taken target rank whole need tie inclusion source_size conv node leaf place said path routes blocks norm name2 level
fp best bucket root component_id fingerprint text_hash text_sha256 keep_id group_size sha hash tokens n_bytes n_tokens over_limit decoded spans __s __copy col""".split()
LONG = "word after word. " * 3000
TEXTS = [None, "", "   \n\t", "Released under the MIT License.", LONG, "a@b.example.com " * 3, "same text here", "same text here", "SAME text here"]
MODEL = toxicity.fit(["you idiot clown", "a fine day", "idiot again here", "all is well here"] * 30, [1, 0, 1, 0] * 30, rounds=20)


@pytest.fixture(scope="module")
def docs(spark):
    data = [(k, t, None, None if k % 3 else "s", None, "x", 1, True, 0, "i", "z", 5) for k, t in enumerate(TEXTS)]
    data += [(20, " ".join(f"w{k}" for k in range(60)), "en", "t", 1, "x", 1, True, 0, "i", "z", 5)]
    data += [data[6], (None, "null id", "en", "t", 1, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DDL)


def operators(bpe, model):
    return {
        1: lambda d: license_scan.license_scan(d),
        2: lambda d: pieces.decode_documents(pieces.encode_documents(d, model), model),
        3: lambda d: toxicity.toxicity(d, MODEL),
        4: lambda d: quality_rules.ledger(d),
        5: lambda d: simhash.near_duplicates(d),
        6: lambda d: mixing.mix(d),
        7: lambda d: token_counts.token_counts(d, bpe),
        8: lambda d: exact_dedup.exact_dedup(d),
        9: lambda d: surrogates.with_surrogates(d, "k"),
        10: lambda d: chat.format_trees(d.select(F.lit(1).alias("conv"), F.monotonically_increasing_id().alias("node"), F.lit(None).cast("long").alias("parent"), F.col("lang").alias("role"), "text", F.lit(None).cast("double").alias("score"))),
    }


@pytest.fixture(scope="module")
def clashing(docs):
    named = docs.columns
    return docs.select(*named, *[F.lit(f"kept {n}").alias(n) for n in INNER if n not in named])


def test_names_clash_with_nothing(clashing, tokenizers):
    """Every operator on a table with all names that operators use; columns that are carried along keep their values."""
    replaced = {2: {"ids", "decoded"}, 3: {"score", "spans"}, 4: {*quality_rules.MEASURES, "failed"}, 9: {"n_entities", "kinds"}}
    for number, run in operators(*tokenizers).items():
        out = run(clashing)
        rows = out.collect()
        if number in replaced:
            assert len(rows) == clashing.count() and set(out.columns) == set(clashing.columns) | replaced[number]
            assert all(r[n] == f"kept {n}" for r in rows for n in INNER if n in clashing.columns and n not in replaced[number])


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, clashing, stage):
    run = dict(pipeline.STAGES)[stage]
    last = stage == pipeline.STAGES[-1][0]
    assert run(spark, clashing.limit(0), "").collect() == []
    out = run(spark, clashing, "")
    rows = out.collect()
    assert out.columns == clashing.columns and 0 < len(rows) <= 2 * clashing.count()
    assert all(r[n] == f"kept {n}" for r in rows for n in INNER) or last
    inputs = {(r["doc_id"], r["text"]) for r in clashing.collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} <= inputs


@pytest.mark.parametrize("number", range(1, 11))
def test_empty_table_and_odd_rows(spark, docs, tokenizers, number):
    run = operators(*tokenizers)[number]
    assert run(docs.limit(0)).collect() == []
    out = run(docs).collect()
    if number in (2, 3, 4, 5, 6, 7, 8, 9):
        assert len(out) == docs.count()
    assert len(set(run(docs).columns)) == len(run(docs).columns)


def test_exact_dedup_of_ties(docs):
    found = exact_dedup.exact_dedup(docs).collect()
    same = [r for r in found if r["text_sha256"] == hashlib.sha256(b"same text here").hexdigest()]
    assert [r["group_size"] for r in same] == [4] * 4 and {r["keep_id"] for r in same} == {8} and sum(r["kept"] for r in same) == 1
    empty = [r for r in found if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"], r["kept"]) for r in empty) == [(0, False), (1, True)]
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(kept.select("doc_id").collect(), key=str) == sorted(set(kept.select("doc_id").collect()), key=str)
    assert kept.count() == sum(r["kept"] for r in found)


def test_near_dedup_keeps_one_of_each(docs):
    found = simhash.near_duplicates(docs)
    groups = found.select("component_id").distinct().count()
    kept = simhash.kept_documents(docs)
    assert kept.count() == groups and kept.columns == docs.columns
    zero = {r["doc_id"] for r in found.collect() if r["fingerprint"] == 0}
    assert zero == {0, 1, 2}


def test_repeated_rows_are_mixed_apart(docs):
    taken = mixing.mix(docs).collect()
    rows = mixing.mixed_documents(docs)
    assert rows.count() == sum(r["copies"] for r in taken) and rows.columns == docs.columns
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in taken)


def test_clashing_columns_are_replaced(docs):
    led = quality_rules.ledger(docs)
    assert led.columns.count("failed") == 1 and led.where("doc_id = 0").first()["n_words"] == 0
    assert surrogates.with_surrogates(docs, "k").where("doc_id = 0").first()["text"] is None
    assert toxicity.toxicity(docs, MODEL).where("doc_id = 1").first()["score"] < 0.5
