"""The pipeline from end to end on small folders with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rinseworks.llm.queries import vocabulary

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, entry string, row int, kind long"
WORDS = [f"word{i}" for i in range(300)]


def folder(spark, path, docs, labels=(), benchmark=()):
    tables = {
        "documents": ([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2) for i, t in docs], DOCUMENTS),
        "labels": (list(labels), "doc_id long, quality int, toxic int"),
        "benchmark": (list(benchmark), "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def pieces_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_stages_take_effect(spark, tmp_path):
    copy, item = prose(1, 90), "what is the sum of all small numbers below the tenth prime"
    near = copy.rsplit(" ", 1)[0] + " other"
    docs = [
        (1, copy), (2, copy), (3, near), (None, copy), (4, prose(2, 40) + " " + item + " " + prose(3, 40)),
        (5, "Please write to jo.doe@example.org or call +49 170 1234567 today."), (6, None), (7, ""), (8, prose(4, 3_000)),
        (9, "clean and short"), (9, prose(5, 30)), (None, prose(6, 30)), (10, "one"), (11, "one"),
    ]
    path = folder(spark, tmp_path, docs, benchmark=[(1, item), (2, None), (3, "")])
    got = pieces_of(corpus_pipeline.run(spark, path).collect())
    assert set(got) == {1, 5, 6, 7, 8, 9, 10, None}
    encode = Tokenizer.from_file(vocabulary()["vocabulary"])
    texts = {
        1: [copy], 5: ["Please write to [EMAIL] or call [PHONE] today."], 6: [""], 7: [""], 8: [prose(4, 3_000)],
        9: ["clean and short", prose(5, 30)], 10: ["one"], None: [prose(6, 30)],
    }
    for key, want in texts.items():
        sizes = [len(encode.encode(t, add_special_tokens=False).ids) + 1 for t in want]
        assert sum(r.length for r in got[key]) == sum(sizes), key
        assert {r.doc_tokens for r in got[key]} == set(sizes), key
    for pieces in [r for rows in got.values() for r in rows], :
        filled = {}
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 1024


@pytest.mark.parametrize("docs", [[], [(None, None), (None, None)], [(1, "toxic words here"), (2, "")]])
def test_tables_that_are_empty_or_nearly(spark, tmp_path, docs):
    path = folder(spark, tmp_path, docs)
    rows = corpus_pipeline.run(spark, path).collect()
    assert len({r.doc_id for r in rows}) == len({i for i, _ in docs})


def test_toxic_documents_leave_first(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, prose(100 + i, 12) + (f" you utter slimehead {rng.choice(WORDS)}" if i % 2 else " and so on")) for i in range(120)]
    labels = [(i, 1, i % 2) for i in range(120)]
    path = folder(spark, tmp_path, docs, labels)
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, table, path)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 2 == 0}
    assert kept.agg(F.max("n_chars")).first()[0] == max(len(t) for i, t in docs if i % 2 == 0)
