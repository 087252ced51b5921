"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lowers the case, turns look-alike letters of other scripts and digits used as
letters into the letters they stand for, and keeps one blank between words. The lexicon
holds whole words and word beginnings, each with a weight; exception phrases are word
pairs in which an entry is harmless and does not count. A text's score is a logistic
function of its largest weight, its total weight and the total normalised by length.

The lexicon is learned from a bounded sample of labelled rows: Spark counts how many toxic
and other texts contain each word and beginning, and in how many different contexts (word
before, word after) each stands. Near copies of a toxic text repeat its harmless words in
the same contexts, insults stand in ever new ones; so an entry is kept if most of its
contexts differ, or if it explains toxic texts that no entry kept before explains.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable
from rinseworks.llm.learning import fold, labelled_sample, sigmoid
from rinseworks.llm.words import pieces

#: Letters of other scripts, signs and digits that stand for Latin letters.
LOOKALIKES = dict(zip("аеорсхуікмнтвοανικρτυ", "aeopcxyikmhtboavikptu")) | dict(
    zip("0134578@$", "oieastbas")
)
_FOLD = str.maketrans(
    LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF21 + i): chr(97 + i) for i in range(26)}
)
_APART = re.compile(r"[^\w]+|[\d_]+")
_DIGITS = re.compile(r"(?<!\w)[\d@$.,:()+-]+(?!\w)")

SAMPLE = 20_000
CANDIDATES = 4_000
BEGINNINGS = (4, 5, 6, 7)


def folded(text: str) -> str:
    """The text's words, folded, with one blank before, between and after them.

    Numbers go first: only digits within words stand for letters.
    """
    return f" {_APART.sub(' ', _DIGITS.sub(' ', text.lower()).translate(_FOLD)).strip()} "


@dataclass
class Lexicon:
    """Entries (``" word "`` or ``" beginning"``) with weights, exception phrases and the
    logistic function's four coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry in self.weights:
            found.add_word(entry, (len(entry), entry))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def spans(self, automaton, text: str) -> list[tuple[int, int, str]]:
        """Start, last position and name of entries in a folded text, outside exception phrases."""
        if automaton is None:
            return []
        found, spared = [], []
        for end, (length, entry) in automaton.iter(text):
            if entry is None:
                spared.append((end - length + 1, end))
            else:
                found.append((end - length + 1, end, entry))
        if spared:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in spared)]
        return found

    def matches(self, automaton, text: str) -> list[str]:
        return [m[2] for m in self.spans(automaton, text)]

    def features(self, automaton, text: str) -> tuple[float, float, float]:
        """Largest weight, logarithm of the total, and total by square root of words."""
        weights = [self.weights[e] for e in self.matches(automaton, text)]
        total = sum(weights)
        words = max(1, text.count(" ") - 1)
        return max(weights, default=0.0), float(np.log1p(total)), total / np.sqrt(words)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.coefficients[0] + features @ np.array(self.coefficients[1:]))


def terms(text: str) -> set[str]:
    """Candidate entries of a folded text."""
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def _evidence(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Log-likelihood ratio of the share of toxic texts among those with the entry."""
    base = all_toxic / max(1, all_toxic + all_clean)
    share = toxic / np.maximum(1, toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = toxic * np.log(share / base), clean * np.log((1 - share) / (1 - base))
    return np.where(share > base, 2 * sum(np.nan_to_num(p, posinf=0, neginf=0) for p in parts), 0)


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE,
    candidates: int = CANDIDATES, evidence: float = 25.0, lift: float = 20.0, variety: float = 0.6,
) -> Lexicon:
    """A lexicon from at most ``sample`` labelled rows for which ``learn`` holds.

    Without toxic or without other rows the lexicon is empty and scores everything low.
    """
    rows = durable(labelled_sample(docs, labels, "toxic", learn, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                tally[int(label == 1)].update(terms(folded(text)))
                tally[int(label == 1)][""] += 1
        keys = list(tally[0].keys() | tally[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([tally[k][t] for t in keys], pa.int64()) for k in (1, 0))],
            ["term", "toxic", "clean"],
        )

    counts = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    totals = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    all_toxic, all_clean = totals
    if not (all_toxic and all_clean):
        return Lexicon()
    base = all_toxic / (all_toxic + all_clean)
    strength = F.expr(
        f"toxic * ln(toxic / (toxic + clean) / {base!r}D)"
        f" + if(clean = 0, 0D, clean * ln(clean / (toxic + clean) / {1 - base!r}D))"
    )
    counts = counts.where(f"term <> '' and toxic >= 4 and toxic > {base!r}D * (toxic + clean)")
    best = counts.orderBy(strength.desc(), F.length("term").desc(), "term").limit(candidates).toPandas()
    keep = _evidence(best.toxic.to_numpy(float), best.clean.to_numpy(float), all_toxic, all_clean) >= evidence
    best = best[keep]
    everything = Lexicon(dict.fromkeys(best.term, 1.0))
    names = {t: i for i, t in enumerate(best.term)}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = everything.automaton()
        for batch in batches:
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                text = folded(text)
                out += [(names[e], _context(text, start), label) for start, _, e in everything.spans(automaton, text)]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32()))], ["at", "context", "label"]
            )

    each = rows.mapInArrow(contexts, "at int, context long, label int").groupBy("at", "context").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("clean")
    )
    each = each.groupBy("at").agg(
        F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("clean") > 0).alias("clean"), F.sum("toxic").alias("all")
    ).toPandas().set_index("at").reindex(range(len(best)), fill_value=0)  # one row for each candidate
    rate = np.log((each.toxic.to_numpy() + 0.5) / all_toxic) - np.log((each.clean.to_numpy() + 0.5) / all_clean)
    varied = each.toxic.to_numpy() >= variety * np.maximum(1, each["all"].to_numpy())

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = everything.automaton()
        for batch in batches:
            found = [
                sorted({names[m] for m in everything.matches(automaton, folded(t))}) for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column("label")], ["found", "label"]
            )

    # One short list for each row of the bounded sample that has a candidate at all.
    hit = rows.mapInArrow(incidence, "found array<int>, label int").where("label = 1 and size(found) > 0").collect()
    good = set(np.flatnonzero(rate >= np.log(lift)))
    found = [[e for e in r.found if e in good] for r in hit]
    chosen = _chosen(found, list(best.term), varied, best.clean.to_numpy(float), all_toxic, all_clean, evidence)
    everything.weights = {t: float(w) for t, w in zip(best.term, rate)}
    entries = [best.term.iloc[i] for i in chosen]
    lexicon = Lexicon({e: everything.weights[e] for e in entries})
    lexicon.exceptions = _harmless(rows, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([lexicon.features(automaton, folded(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column("label")], ["a", "b", "c", "label"])

    fitted = rows.mapInArrow(measure, "a double, b double, c double, label int").toPandas()
    lexicon.coefficients = _logistic(fitted[["a", "b", "c"]].to_numpy(), fitted.label.to_numpy(float))
    return lexicon


def _context(text: str, start: int) -> int:
    """A number for the words before and after the one that begins behind ``start``."""
    end = text.find(" ", start + 1)
    before, after = text.rfind(" ", 0, max(start, 0)), text.find(" ", end + 1)
    return zlib.crc32(f"{text[before + 1 : start]} {text[end + 1 : after]}".encode("utf-8", "surrogatepass"))


def _chosen(found, terms, varied, clean, all_toxic, all_clean, evidence) -> list[int]:
    """Entries by falling evidence that neither begin an entry chosen before nor begin with
    one: those in varied contexts, then by the toxic texts that none before explains."""
    holders: dict[int, set[int]] = {}
    for row, entries in enumerate(found):
        for e in entries:
            holders.setdefault(e, set()).add(row)
    chosen: list[int] = []

    def apart(e: int) -> bool:
        return not any(terms[e].startswith(terms[c]) or terms[c].startswith(terms[e]) for c in chosen)

    for e in sorted(holders):  # candidates are numbered by falling evidence
        if varied[e] and apart(e):
            chosen.append(e)
    covered = set().union(*(holders[c] for c in chosen))
    left = {e: rows for e, v in holders.items() if apart(e) and (rows := v - covered)}
    while left:
        sizes = np.array([len(v) for v in left.values()], float)
        strength = _evidence(sizes, clean[list(left)], all_toxic, all_clean)
        top = max(range(len(sizes)), key=lambda i: (strength[i], -list(left)[i]))
        if strength[top] < evidence:
            break
        entry = list(left)[top]
        covered = left.pop(entry)
        chosen.append(entry)
        left = {e: rows for e, v in left.items() if apart(e) and (rows := v - covered)}
    return chosen


def _harmless(rows: DataFrame, lexicon: Lexicon, least: int = 5, share: float = 0.05) -> tuple[str, ...]:
    """Word pairs around an entry that toxic texts almost never hold."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out, labels = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                text = folded(text)
                if not lexicon.matches(automaton, text):
                    continue
                words = text.split()
                near = {i for i, w in enumerate(words) if lexicon.matches(automaton, f" {w} ")}
                here = {" ".join(words[max(0, k) : k + 2]) for i in near for k in (i - 1, i) if k + 2 <= len(words)}
                out += here
                labels += [label] * len(here)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int32())], ["pair", "label"])

    counts = rows.mapInArrow(pairs, "pair string, label int").groupBy("pair").agg(
        F.sum(F.expr("int(label = 1)")).alias("toxic"), F.sum(F.expr("int(label <> 1)")).alias("clean")
    )
    found = counts.where((F.col("clean") >= least) & (F.col("toxic") <= share * F.col("clean")))
    return tuple(r.pair for r in found.orderBy(F.desc("clean"), "pair").limit(1000).collect())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Coefficients by Newton's method, the constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 100, x.T @ (y - p) - ridge * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with ``score`` (0 to 1) and ``n_matches``; other columns are kept.

    A null or empty text matches nothing and gets the lowest score of a text without
    matches. Columns named ``score`` or ``n_matches`` are replaced.
    """
    docs = docs.drop("score", "n_matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part in pieces(batch):
                texts = [folded(t or "") for t in part.column("text").to_pylist()]
                x = np.array([lexicon.features(automaton, t) for t in texts]).reshape(-1, 3)
                n = [len(lexicon.matches(automaton, t)) if v[0] else 0 for t, v in zip(texts, x)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lexicon.scores(x)), pa.array(n, pa.int64())],
                    [*part.schema.names, "score", "n_matches"],
                )

    schema = T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_matches`` of every row of ``docs(doc_id, text)``.

    Learns from labels whose fold (crc32 of doc_id modulo ``folds``) is not 0; a null
    doc_id has no fold and is not held out.
    """
    lexicon = learn_lexicon(docs, labels, fold(folds) != 0, **options)
    return score_toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", F.coalesce(fold(folds) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches",
    )
