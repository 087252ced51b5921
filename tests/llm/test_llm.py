"""Operators on text against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.llm import fingerprint, jaccard_join, language, packing, pii, quality, recompression, toxicity
from rinseworks.llm.components import components
from rinseworks.llm.decontaminate import find_contamination, remove_contaminated
from rinseworks.llm.hilbert import hilbert_shards, shards_sql, write_shards
from rinseworks.llm.learning import fold
from rinseworks.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, entry string"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages and awkward ones, by doc_id."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    for base in texts[:6]:
        for _ in range(4):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
    texts += [t + " " + passage + "\n" + prose(rng, 5) for t in texts[10:16]]
    texts += [texts[3], texts[3].upper(), None, "", " \t\n", "one", "One two", "one  two", "ünï cödé x " * 12]
    texts += ["a " * 50, "a " * 70, "a b " * 30, prose(rng, 3000) + passage]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "x") for i, t in rows], SCHEMA).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"block": 2, "short": 2, "sketch_bits": 6, "broadcast_rows": 0}])
def test_jaccard_components(spark, limits):
    rows = corpus()
    sets, parent = {}, {}
    for i, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        parent[i] = i

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = by_id(jaccard_join.jaccard_components(frame(spark, rows), **limits))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), top(i)) for i, s in sets.items()}
    kept = jaccard_join.one_per_component(frame(spark, rows), **limits)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(i) for i in sets})


def test_jaccard_bitmaps_leave_out_only_what_cannot_link():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 7, 300, 700, 6000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for changed in (0, n // 20, n // 10, n // 9, n // 3, n):
            new = rng.integers(0, 1 << 63, changed, np.uint64)
            sets.append(np.unique(np.concatenate([base[changed:], new, new[: n // 50]])))
    links = np.zeros(len(sets), bool)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            links[i] |= i != j and 100 * common >= 80 * (len(x) + len(y) - common)
    bits = np.frombuffer(b"".join(map(jaccard_join.bitmap, sets)), np.uint8).reshape(len(sets), -1)
    kept = jaccard_join.may_link(bits, np.array(list(map(len, sets))), 80)
    assert (kept | ~links).all()
    chance = np.array([len(x) in range(250, 800) for x in sets]) & ~links
    assert chance.sum() >= 4 and not kept[chance].any()


def test_jaccard_bitmaps_of_long_sets_leave_out_what_cannot_link():
    """Bitmaps grow with their sets, so that long ones are told apart too."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 9_000, np.uint64)
    new = rng.integers(0, 1 << 63, 9_000, np.uint64)
    # 8,192 and 8,500 grams have bitmaps of different widths.
    sets = [base[:8_192], base[:8_500], np.concatenate([base[:5_000], new[:3_500]]), new, new[:400], base[:450]]
    sizes = np.array(list(map(len, sets)))
    bits = [jaccard_join.bitmap(x, jaccard_join.bits_for(len(x))) for x in sets]
    assert len({len(b) for b in bits}) == 3
    assert jaccard_join.may_link_of(bits, sizes, 80).tolist() == [True, True] + 4 * [False]
    # Only pairs of different roots of which one asks count.
    asks, roots = np.array([True, False, True, True, True, False]), np.arange(6)
    assert jaccard_join.may_link_of(bits, sizes, 80, asks, roots).tolist() == [True, True] + 4 * [False]
    assert not jaccard_join.may_link_of(bits, sizes, 80, asks, np.zeros(6, int)).any()
    assert not jaccard_join.may_link_of(bits, sizes, 80, np.ones(6, bool), roots).any()


@pytest.mark.parametrize("n_words", [60, 3_000])
def test_jaccard_searches_only_sets_that_may_link(spark, monkeypatch, n_words):
    """Texts that share a common line fill cells of many blocks; the sets of a few only are searched."""
    rng = random.Random(5)
    line = prose(rng, 30)
    texts = [f"{line} {prose(rng, n_words)} {i}" for i in range(30)]
    texts += [t + " end" for t in texts[:2]]
    written = []
    monkeypatch.setattr(jaccard_join, "durable", lambda df: written.append(durable(df)) or written[-1])
    got = by_id(jaccard_join.jaccard_components(frame(spark, list(enumerate(texts))), block=4, sketch_bits=6))
    assert {i: r.component_id for i, r in got.items()} == {**{i: i for i in range(30)}, 30: 0, 31: 1}
    assert sum(df.count() for df in written if df.columns == ["entry", "grams"]) == 4


def test_jaccard_awkward_keys(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (7, "x"), (7, "x"), (7, "y z"), (None, None)]
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        {(None, 5): 1, (5, 5): 1, (7, 7): 3, (None, None): 1}
    )
    assert jaccard_join.jaccard_components(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}])
def test_one_per_component_keeps_what_nothing_links(spark, limits):
    import corpus_pipeline

    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (7, "x"), (7, "x"), (7, "y z"), (7, "a b c d e f"), (None, None), (None, "lost"), (None, "lost")]
    df = frame(spark, rows)
    for kept in (jaccard_join.one_per_component(df, **limits), corpus_pipeline.drop_near_copies(spark, df, "")):
        assert kept.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, "a b c d e f"), (7, "x"), (7, "y z"), (None, None), (None, "lost")])


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.root) for r in components(edges, "a", "b").collect()} == {(i, 0) for i in range(200)}


def removed(rows, window):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in docs for k in range(len(w) - window + 1))
    out = []
    for words in docs:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append([w for w, g in zip(words, gone) if not g])
    return docs, out


@pytest.mark.parametrize("window,limits", [(35, {}), (12, {"broadcast_rows": 0}), (5, {"rounds": 2})])
def test_remove_repeats(spark, window, limits):
    rows = corpus(2)
    docs, kept = removed(rows, window)
    got = by_id(recompression.remove_repeats(frame(spark, rows), window=window, with_text=True, **limits))
    for (i, _), words, rest in zip(rows, docs, kept):
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(words), len(words) - len(rest)), i
        assert r.kept_sha256 == hashlib.sha256(" ".join(rest).encode()).hexdigest()
        assert r.kept_text == (" ".join(rest) if len(rest) < len(words) else None)
    assert any(0 < len(r) < len(w) for w, r in zip(docs, kept))
    assert recompression.remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_recompression_gives_a_window_the_same_symbol_everywhere():
    rng = np.random.default_rng(5)
    window = rng.integers(0, 4, 35).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = set()
    for _ in range(50):
        before, after = (rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        numbers = np.concatenate([before, window, after])
        starts, key, _ = recompression.standing(numbers, np.array([0, len(numbers)]), 35, 3)
        keys.add(int(key[starts == len(before)][0]))
    assert len(keys) == 1


def test_fingerprints(spark):
    rows = [(i * 3, t) for i, t in corpus(3)] + [(None, "lost key")]
    got = by_id(fingerprint.fingerprint_with_next(frame(spark, rows), runs=5))
    order = [(None, "lost key"), *rows[:-1]]
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    texts = dict(rows)
    for i, r in got.items():
        for j, s in got.items():
            if (texts[i] or "") == (texts[j] or ""):
                assert r.fingerprint == s.fingerprint
    long = [r for i, r in got.items() if len(texts[i] or "") > 300]
    assert np.mean([r.near_edited for r in long]) > 0.35 > np.mean([r.near_next for r in long])
    chain = fingerprint.read(long[0].fingerprint)
    assert fingerprint.written(chain) == long[0].fingerprint and fingerprint.likeness(chain, chain) == 1
    assert fingerprint.fingerprint_with_next(frame(spark, rows).where("false")).count() == 0
    one = fingerprint.fingerprint_with_next(frame(spark, [(4, "abcd")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abab").hexdigest()]


def test_entropy_classes_against_counting():
    data = np.frombuffer(("the quick brown fox " * 9 + "aaaa" * 40 + "zq!9" * 20).encode(), np.uint8)
    most = int(fingerprint._G[64])
    for i, c in enumerate(fingerprint.entropy_classes(data)):
        assert c == (most - int(fingerprint._G[np.bincount(data[i : i + 64])].sum())) * 256 // (most + 1)


def test_hilbert_shards(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i, t in corpus(4)] + [(None, "x", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = hilbert_shards(df, shards=7).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(got) == len(rows)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got.sort_values(["shard", "slot"]).curve.diff().dropna() >= 0).all()
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(shards_sql(shards=7)).df()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[key].fillna(-1).astype(int).values)) == sorted(map(tuple, want[key].fillna(-1).astype(int).values))
    assert hilbert_shards(df.where("false")).count() == 0
    again = df.unionByName(df.limit(3)).withColumn("slot", F.lit("x"))
    write_shards(again, str(tmp_path / "out"), shards=3)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("shard").count().count() == 3 and not again.drop("slot").exceptAll(out.select(df.columns)).count()
    assert out.count() == again.count() and sorted(r.slot for r in out.where("shard = 1").collect()) == list(range(out.where("shard = 1").count()))


def test_hilbert_neighbours_touch(spark):
    from rinseworks.llm.hilbert import hilbert_index

    cube = spark.range(8**3).selectExpr("int(id % 8) as _level_0", "int(id / 8) % 8 as _level_1", "int(id / 64) as _level_2")
    cells = [tuple(r)[:3] for r in cube.withColumn("h", hilbert_index([F.lit(0)] * 3, 3)).orderBy("h").collect()]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(cells, cells[1:]))


def base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
            if {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"),
                "card": 13 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "ü write a.b+c@mail.example.com_d@x.y.z or 1.2.3.4.5.6.7.8 and 300.1.1.1 0255.001.2.3 😀 4012 8888 8888 1881, +1 (017) 555-7713.",
    "4012888888881881-4012888888881881 x@y x@y.z. @a.b +12 +1--- +49 30 1234567890123456", "9" * 3000, "a." * 3000 + "@b", None, "",
    "5105-1051-0510-5100 10.0.0.1 mail [at] host.de +4 4 4 4 4 4 4 4 4 4", "+1 +2 +3 (555) 123 4567\n+441234567890",
]


def test_pii_base_spans_and_redaction(spark):
    rows = list(enumerate(PERSONAL * 2)) + [(None, PERSONAL[0]), (1, "call +1 (017) 555-7713")]
    got = pii.pii_digest(frame(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert all(set(base_spans(dict(rows[:-1])[r.doc_id] or "")) <= set(r.spans.split(",")) | {""} for r in got if r.doc_id != 1)
    df = frame(spark, rows)
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = [r.text for r in clean.where("doc_id is null or doc_id = 1").collect()]
    assert "call [PHONE]" in texts and any("[EMAIL]" in t and "[CARD]" in t and "😀" in t for t in texts)
    for r in (r for r in got if r.doc_id is not None and r.doc_id > 1):
        text, out, at = PERSONAL[r.doc_id % len(PERSONAL)] or "", "", 0
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want = out + text[at:]
        assert (clean.where(f"doc_id = {r.doc_id}").first().text or "") == want
    assert pii.pii_digest(df.where("false")).count() == 0


def test_pii_trees_add_likely_spans(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        phone = f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        text = f"please call +1 {phone} now" if i % 2 else f"order {rng.randint(10**7, 10**8)} of {rng.randint(1900, 2030)}-{rng.randint(100, 999)}-1"
        rows.append((i, text))
    rows.append((1000, "please call 1 (415) 555-2671 now"))
    got = by_id(pii.pii_digest(frame(spark, rows)))
    assert all(got[i].n_phone == i % 2 for i in range(400))
    assert sum(len(got[i].spans) > 0 for i in range(0, 400, 2)) <= 8


def test_pii_trees_add_what_no_exact_pattern_finds(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        phone = f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, (
            f"order {rng.randint(10**7, 10**8)} of 2024-0{rng.randint(1, 9)}-{rng.randint(10, 28)} at 3 @ 2.{i}",
            f"please call +1 {phone} now", f"write to {rng.choice(VOCABULARY)}.x@mail{i}.example.com now",
        )[i % 3]))
    rows += [(1000, "please call 1 (415) 555-2671 now"), (1001, "write to ann.b [at] mail7 [dot] example [dot] com now"),
             (1002, "order 87654321 of 2024-03-15 at 3 @ 2.5")]
    got = by_id(pii.pii_digest(frame(spark, rows)))
    assert got[1000].spans == "phone:12:28" and got[1001].spans == "email:9:49" and got[1002].spans == ""
    assert not any(got[i].spans for i in range(0, 600, 3))


def test_pii_trees_learn_from_every_labelled_candidate(spark, monkeypatch):
    rows = [(i, " ; ".join([f"order 2024-03-{10 + i % 18}", f"call +1 (415) 555-{1000 + i}"] * 50)) for i in range(300)]
    learnt = []

    class Counted(pii.GBTClassifier):
        def fit(self, learning):
            learnt.append(learning.count())
            return super().fit(learning)

    monkeypatch.setattr(pii, "GBTClassifier", Counted)
    found = pii.find_spans(frame(spark, rows))
    assert found.selectExpr("sum(size(base))").first()[0] == 15_000
    assert abs(learnt[0] - 30_000 * 3 / 4) < 500


def test_decontamination(spark):
    item = "Tom has 5 apples and gives 3 apples to Ann who then walks 12 km with Tom to buy 5 pears"
    other = item.replace("5", "9").replace("Tom", "Max").replace("Ann", "Eva").replace("12", "40")
    mixed = "Tom has 5 apples and gives 3 apples to Ann who then walks 12 km with Joe to buy 5 pears"
    wrong = "Tom has 5 apples and gives 3 apples to Ann who then walks 12 km with Tom to buy 7 pears"
    bench = spark.createDataFrame(
        [(1, item), (2, "a short one here"), (3, None), (4, ""), (5, "x y"), (1, item)], "item_id long, text string"
    )
    rows = [
        (1, f"intro words, {item}. The end"), (2, f"intro words, {other} at last"), (3, f"intro words, {mixed} at last"),
        (4, "unrelated words " * 40), (5, None), (6, ""), (7, "so A SHORT, one here!"), (8, item[:40]), (None, item), (1, item),
        (9, f"intro words, {wrong} at last"),
    ]
    df = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in find_contamination(df, bench).collect()}
    assert {(1, 1), (2, 1), (7, 2), (None, 1)} <= set(got) and not {4, 5, 6, 8} & {d for d, _ in got}
    assert got[1, 1].exact and not got[2, 1].exact
    assert {k: v.covered_words for k, v in got.items()} == {
        (r.doc_id, r.item_id): r.covered_words for r in find_contamination(df, bench, broadcast_rows=0).collect()
    }
    assert got.get((9, 1)) is None or got[9, 1].covered_words < got[1, 1].covered_words
    kept = remove_contaminated(df, bench)
    assert kept.columns == df.columns and {4, 5, 6, 8} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id <= 2").isEmpty()
    assert find_contamination(df, bench.where("false")).isEmpty() and find_contamination(df.where("false"), bench).isEmpty()


def test_decontamination_keeps_windows_beside_a_clashing_value(spark):
    item = "now Tom has 5 apples and gives 3 apples to Ann who then walks 12 km with Tom to buy 5 pears"
    one = item.replace("5 pears", "7 pears")
    both = "now Max has 9 apples and gives 2 apples to Eva who then walks 40 km with Max to buy 7 pears"
    third = "now Max has 8 apples and gives 4 apples to Eva who then walks 30 km with Max to buy 8 pears"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"so {one}"), (2, f"so {both}"), (None, f"so {third}"), (None, f"so {item}")]
    got = [(r.doc_id, r.covered_words, r.exact) for r in find_contamination(frame(spark, rows), bench).collect()]
    assert sorted(got, key=str) == [(1, 20, False), (2, 16, False), (None, 22, False), (None, 22, True)]


def test_decontamination_keeps_clean_rows_that_share_a_key(spark):
    item = "now Tom has 5 apples and gives 3 apples to Ann who then walks 12 km"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "clean one"), (None, None), (None, "clean one"), (3, f"so {item}"), (3, "clean three")]
    rows += [(None, item[: len(item) // 2 - 8]), (None, item[len(item) // 2 - 8 :])]
    kept = [(r.doc_id, r.text) for r in remove_contaminated(frame(spark, rows), bench, share=0.7).collect()]
    assert sorted(kept, key=str) == sorted([*rows[1:4], *rows[5:]], key=str)


def test_decontamination_finds_copies_of_items_rich_in_numbers(spark):
    series, names = "the row 3 5 8 13 21 34 55 89 144 233 ends", "with Ann, Bob, Carl, Dora, Emil, Fritz, Gerd, Hanna and Ida"
    bench = spark.createDataFrame([(1, series), (2, names)], "item_id long, text string")
    rows = [(1, f"so {series} again"), (2, f"so {names} again"), (3, f"so {series.replace('233', '234')}"), (4, "the row 1 2 4 6 10 12 16 18 22 28 ends")]
    got = {(r.doc_id, r.item_id): r.covered_words for r in find_contamination(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): 13, (2, 2): 11, (3, 1): 11}


def test_decontamination_types_words_wherever_they_stand(spark):
    item = "Tom has 5 apples. Tom gives 3 apples to Ann. Then Ann walks 12 km. How many apples has Tom?"
    other = item.replace("Tom", "Max").replace("Ann", "Eva").replace("5", "9").replace("12", "40")
    short = "Every day Ann eats 3 of the apples"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    rows = [
        (1, f"{other}"), (2, other.replace(" ", "\n  ")), (3, f'text: "{other}" (end)'), (4, f"and every {short[6:]} again"),
        (5, f"so {item.lower()}"), (6, item.upper()), (7, other.replace(" ", "\u00a0")), (8, f"{item[:25]} and Joe sleeps"),
    ]
    got = {(r.doc_id, r.item_id): r.covered_words for r in find_contamination(frame(spark, rows), bench).collect()}
    assert got == {(4, 2): 8} | {(i, 1): 20 for i in (1, 2, 3, 5, 6, 7)}


def test_packing(spark):
    from tokenizers import Tokenizer

    files = vocabulary()
    rows = corpus(7) + [(500, "it's <|endoftext|> here"), (501, "日本語 ѐ ' ' 12'll  \n\n x" * 40), (502, "word " * 5000)]
    got = packing.pack(frame(spark, rows), **files, pool=16).toPandas().sort_values(["doc_id", "start"])
    whole = Tokenizer.from_file(files["vocabulary"])
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.doc_id == i]
        assert b"".join(mine.ids) == ids.tobytes() and set(mine.doc_tokens) == {len(ids)}
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert packing.pack(frame(spark, rows).where("false"), **files).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 1024, 200)
    window, count = packing.fit(lengths, 1024)
    sums = np.bincount(window, lengths, minlength=count)
    assert sums.max() <= 1024 and sums.min() > 0 and count * 1024 < 1.1 * lengths.sum()
    even = np.bincount(packing.differencing(rng.integers(1, 100, 400), 10), minlength=10)
    assert even.min() > 0


def labelled(spark, label):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(rng, rng.randint(5, 60)), i % 4 == 0
        if bad and label == "toxic":
            text += " " + rng.choice(["VILEword", "vilew0rd", "vіleword", "grubling", "grubster"])
        if bad and label == "quality":
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(bad) if label == "toxic" else int(not bad)))
    rows += [(900, None), (901, ""), (902, "x" * 50_000)]
    labels.append((900, None))
    return frame(spark, rows), spark.createDataFrame(labels, f"doc_id long, {label} int"), dict(labels)


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, "toxic")
    got = by_id(toxicity.toxicity(docs, labels))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and i < 600]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert got[900].score == got[901].score < 0.5 and len(got) == 603
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    lexicon = toxicity.Lexicon({" trash ": 4.0}, ("trash can",))
    found = lexicon.automaton()
    assert lexicon.matches(found, toxicity.folded("The tr4sh can, TRAЅH! 4 5")) == []
    assert lexicon.matches(found, toxicity.folded("you trash! you tr@sh")) == [" trash ", " trash "]


def test_quality(spark):
    docs, labels, truth = labelled(spark, "quality")
    got = by_id(quality.quality(docs, labels))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([got[i].predicted == truth[i] for i in truth if i < 600 and got[i].held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    assert {r.score for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


def test_pairs_of_features_learn_what_single_ones_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, pairs=1)
    assert model.pairs == [(0, 1)] and ((model.margin(x) > 0) == y).mean() > 0.95


def test_language(spark):
    rng = random.Random(10)
    parts = {"aa": "bal dor kin tuv", "bb": "shel wro gly phn", "cc": "ñao éui öxü çea"}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        pool = parts[lang].split()
        rows.append((i, " ".join("".join(rng.choices(pool, k=2)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !! 3", "bb"), (903, "balbal dorkin", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.language(df))
    truth = {i: v for i, _, v in rows}
    assert np.mean([got[i].lang_pred == truth[i] for i in range(300) if got[i].held_out]) > 0.98
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "aa"
    assert {r.lang_pred for r in language.language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_runs_of_empty_texts_are_short():
    import tracemalloc

    texts = pa.array(["", None, "a"] * 3_000 + ["some words of English " * 40])
    tracemalloc.start()
    row, feature, count = language.gram_counts(texts)
    assert tracemalloc.get_traced_memory()[1] < 1 << 24
    tracemalloc.stop()
    assert list(row[:3000]) == list(range(2, 9000, 3)) and set(row[3000:]) == {9000}
    assert count[row == 9000].sum() == sum(880 - k for k in range(3)) and (np.diff(feature[row == 9000]) > 0).all()
    for bits in (6, 14):
        row, feature, count = language.gram_counts(texts.slice(8990), bits)
        alone = [language.gram_counts(texts.slice(i, 1), bits) for i in range(8990, 9001)]
        assert [(int(f), int(c)) for f, c in zip(feature, count)] == [(int(f), int(c)) for a in alone for f, c in zip(a[1], a[2])]


def test_language_learns_from_its_folds_alone(spark):
    """Held-out texts and rows without a language change nothing; ids that two languages share mix nothing up."""
    rng = random.Random(3)
    pools = {"aa": "bal dor kin tuv".split(), "bb": "shel wro gly phn".split()}
    rows = [(i // 2, " ".join("".join(rng.choices(pools[v], k=2)) for _ in range(9)), v) for i, v in enumerate("aa bb".split() * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred): r for r in language.language(df).collect()}
    assert set(got) == {(i, v) for i, _, v in rows}
    other = df.withColumn("text", F.when(fold(3) == 1, F.lit("something else, éé 77")).otherwise(F.col("text")))
    other = other.unionByName(spark.createDataFrame([(7, "zzz " * 99, None)], df.schema))
    for r in language.language(other).collect():
        if not r.held_out and (r.doc_id, r.score) != (7, 0.0) and (r.doc_id, r.lang_pred) in got:
            same = got[r.doc_id, r.lang_pred]
            assert r.score == same.score or r.doc_id == 7
    scores = [r.score for r in got.values()]
    assert np.mean(np.array(scores) > 0.9999) < 0.5 and min(scores) > 0.5


def test_language_scores_are_dense_products(spark):
    """TF-IDF, logits and temperature by plain loops over code points."""
    rng = random.Random(8)
    texts = ["Été ÉTÉ", "abc abd", "", None, "日本語 abc", "x" * 5] + [prose(rng, 9) for _ in range(20)]
    weights = np.random.default_rng(1).normal(size=(1 << 14, 3))
    model = language.LanguageModel(["a", "b", "c"], np.random.default_rng(2).uniform(1, 4, 1 << 14), weights, np.array([0.1, 0.2, -0.3]), 1.7)
    for text, logits in zip(texts, model.logits(pa.array(texts))):
        counts = Counter()
        low = (text or "").lower()
        for order in (1, 2, 3):
            for i in range(len(low) - order + 1):
                gram = 0
                for c in low[i : i + order]:
                    gram = (gram * 0x01000193 + ord(c) + order) % 2**32
                gram = (gram ^ gram >> 15) * 0x2C1B3C6D % 2**32
                counts[gram >> 18] += 1
        x = np.zeros(1 << 14)
        for f, n in counts.items():
            x[f] = (1 + np.log(n)) * model.idf[f]
        x /= np.linalg.norm(x) or 1
        assert np.allclose(logits, x @ weights + model.bias)


def thue_morse(letters, n):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_of_one_pattern_differ(spark, n):
    a, b = thue_morse("ab", n), thue_morse("ba", n)
    rows = [(1, a), (2, b), (3, a.upper()), (4, b + " x")]
    got = by_id(jaccard_join.jaccard_components(frame(spark, rows)))
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4}
    tail = prose(random.Random(1), 40)
    got = by_id(recompression.remove_repeats(frame(spark, [(1, f"{a} {tail}"), (2, f"{b} {tail}")])))
    assert {i: r.n_removed for i, r in got.items()} == {1: 40, 2: 40}


def test_five_thousand_rows_of_one_null_key(spark):
    """Rows find their own text again, not those of all rows of the key."""
    rng = random.Random(2)
    passage = prose(rng, 45)
    texts = [f"{prose(rng, 30)} {i} {passage}" for i in range(2_500)] * 2
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    start = time.time()
    got = recompression.remove_repeats(df).collect()
    assert all(r.n_removed == r.n_words for r in got) and len(got) == 5_000
    assert jaccard_join.one_per_component(df).count() == 2_500
    assert time.time() - start < 120


def test_pii_positions_in_a_text_of_many_numbers(spark):
    """200,000 matches: positions come from running sums, not from growing arrays."""
    n = 200_000
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr(
        f"concat('é ', array_join(transform(sequence(1, {n}), i -> string(i)), ' '), ' x +49 170 1234567 ip 1.2.3.4')").alias("text"))
    start = time.time()
    row = pii.base_spans(df).selectExpr("_phone", "_ip", "text").first()
    assert time.time() - start < 20
    (phone,), (ip,) = row._phone, [x for x in row._ip if x.v == "1.2.3.4"]
    assert row.text[phone.s : phone.e] == phone.v and row.text[ip.s : ip.e] == "1.2.3.4"


def test_decontamination_finds_short_items_as_whole_texts(spark):
    items = spark.createDataFrame([(1, "Why so?"), (2, "Paris"), (3, "one two three four five")], "item_id long, text string")
    docs = frame(spark, [(1, "why  so"), (2, "he asked why so often"), (3, "PARIS!"), (4, "Paris is big"), (5, "and one two three four five six"), (6, None), (7, "")])
    got = {(r.doc_id, r.item_id) for r in find_contamination(docs, items).collect()}
    assert got == {(1, 1), (3, 2), (5, 3)}
    assert sorted(r.doc_id for r in remove_contaminated(docs, items).collect()) == [2, 4, 6, 7]


def test_fold_of_a_null_key(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(fold(3)).first()[0] is None


def test_words_of_bytes():
    from rinseworks.llm.words import pieces, word_numbers

    texts = [None, "", " a", "b ", "a b\x0bc\x1cd", "x", "a"]
    numbers, first = word_numbers(pa.array(texts))
    assert list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    names = defaultdict(set)
    for n, w in zip(numbers.tolist(), [w for t in texts for w in WORD.findall(t or "")]):
        names[w].add(n)
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == len(names)
    batch = pa.record_batch([pa.array(["ab", None, "c" * 10, ""])], ["text"])
    assert pa.Table.from_batches(list(pieces(batch, limit=3))).to_pydict() == {"text": ["ab", None, "c" * 10, ""]}


def test_toxicity_keeps_insults_that_occur_together_and_no_word_of_near_copies(spark):
    import random

    pick = random.Random(5)
    calm = [a + b for a in ("bal", "cor", "dun", "fel", "gim", "hos", "jut") for b in ("ane", "ibo", "ulo", "ery", "ask", "ont")]
    insults = ["blargh", "quozzit", "fremple"]
    rows, marks = [], []
    for i in range(600):
        words = [pick.choice(calm) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:  # always two insults, so that each toxic text has another explanation
            for w in pick.sample(insults, 2):
                words.insert(pick.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    base = [pick.choice(calm) for _ in range(30)] + ["mildword"] + [pick.choice(calm) for _ in range(30)]
    for i in range(600, 640):  # near copies of one toxic text
        rows.append((i, " ".join(base + ["blargh", "fremple", pick.choice(calm), str(i)])))
        marks.append((i, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels, F.lit(True))
    held = {e.strip() for e in lexicon.weights}
    assert all(any(w.startswith(e) for e in held) for w in insults)
    assert not any("mildword".startswith(e) for e in held)
