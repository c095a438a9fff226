"""Weak-label classifier: labellers vote, EM weighs them, a hashed linear scorer learns the posterior.

Two questions are asked of a text, each with its own labellers: is it junk, and is it abusive? Labellers are
rules that fire on bad texts; people, where they have labelled a document, are one more labeller. The votes
of all documents are counted by pattern (3^labellers patterns at most) and expectation-maximisation fits,
per question, the share of bad texts and how often each labeller says bad of bad and of good texts. A
bounded sample of documents with their posterior as label trains a logistic scorer over hashed word,
symbol and shape features; it scores all documents.

Parameters that bound the fit: about ``SAMPLE`` documents, half of them labelled by people where there are
such, and the ``FEATURES`` features that tell most in it. Votes, their counts and the scores cover every
document.

Defined results: a null or blank text scores 1 on junk and is rejected; repeated rows and repeated ids are
scored each on its own; of several labels of a document the worst counts, labels of 1 and 0 only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.flat import IS_BLANK, Flat, chunks, distinct, mix
from fleetsight.session import checkpointed

SAMPLE = 12_000
FEATURES = 2_048
HASH_BITS = 18
THRESHOLD = 0.6
# Rounds and the strength of the prior, as a share of the documents.
EM_ROUNDS = 60
EM_PRIOR = 0.05
# How often people call good and bad texts bad: given, as the rules are measured by them.
PEOPLE = (0.005, 0.95)
# Share of bad texts where people have labelled none; it weighs as much as 100 labels.
BAD_SHARE = 0.1
FIT_ROUNDS = 200
FIT_RATE = 0.5
FIT_RIDGE = 2e-4

QUESTIONS = ("junk", "abuse")
# The last labeller of each question is people's labels, the others are rules over the text.
JUNK_LABELLERS = ("symbols", "capitals", "separators", "repeated lines", "word variety", "word length", "people")
ABUSE_LABELLERS = ("insult present", "two insults", "people")
# English words of abuse; a parameter of the labellers, not of the scorer.
INSULTS = (
    "clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split()
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_WORD = _LETTER.copy()
_WORD[0x30:0x3A] = True
_SYMBOL = ~_WORD & ~IS_BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _insult_hashes() -> np.ndarray:
    flat = Flat([" ".join(INSULTS).encode()])
    return np.sort(flat.hashes(*flat.words()))


class Facts:
    """Figures, votes and features of a chunk of texts, one row or list per text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.flat = flat = Flat(texts)
        data = flat.data
        per_text = lambda mask: np.add.reduceat(mask, flat.starts, dtype=np.int64)
        share = lambda part, whole: part / np.maximum(whole, 1)
        filled = per_text(~IS_BLANK[data])
        self.blank = filled == 0
        starts, ends = flat.words()
        self.n_words = np.diff(flat.first_of(starts))
        self.symbols = share(per_text(_SYMBOL[data]), filled)
        self.capitals = share(per_text(_UPPER[data]), per_text(_LETTER[data]))
        self.separators = share(per_text(data == ord("|")), self.n_words)
        self.length = share(filled, self.n_words)
        kinds = self._distinct(starts, flat.hashes(starts, ends))
        self.variety = np.where(self.n_words > 1, np.log(np.maximum(kinds, 1)) / np.log(np.maximum(self.n_words, 2)), 1.0)
        starts, ends = flat.runs(data != ord("\n"))
        self.n_lines = np.diff(flat.first_of(starts))
        self.repeated = 1 - share(self._distinct(starts, flat.hashes(starts, ends)), self.n_lines)
        self.repeated[self.n_lines == 0] = 0
        self.word_starts, word_ends = flat.runs(_WORD[data])
        self.word_hashes = flat.hashes(self.word_starts, word_ends, _LOWER[data])

    def _text_of(self, starts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.flat.starts.size), np.diff(self.flat.first_of(starts)))

    def _distinct(self, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Different hashes per text."""
        keys = (self._text_of(starts).astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
        return np.bincount((distinct(keys) >> np.uint64(40)).astype(np.int64), minlength=self.flat.starts.size)

    def votes(self) -> list[np.ndarray]:
        """Per question one row per text: 2 where a rule says bad, else 0, in the labellers' order without people."""

        insult = np.isin(self.word_hashes, _insult_hashes())
        starts, hashes = self.word_starts[insult], self.word_hashes[insult]
        insults, kinds = np.diff(self.flat.first_of(starts)), self._distinct(starts, hashes)
        junk = [
            self.symbols > 0.07,
            self.capitals > 0.25,
            self.separators > 0.1,
            (self.repeated > 0.3) & (self.n_lines > 2),
            (self.variety < 0.85) & (self.n_words >= 20),
            self.blank | (self.length > 20),
        ]
        abuse = [insults > 0, kinds > 1]
        return [np.where(np.stack(rules, axis=1), 2, 0).astype(np.int8) for rules in (junk, abuse)]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hashed feature), each pair once, in order of text and feature."""
        figures = [
            np.floor(self.symbols * 50), np.floor(self.capitals * 20), np.ceil(self.separators * 10),
            np.floor(self.repeated * 10), np.floor(np.maximum(self.variety, 0.5) * 40), np.minimum(np.floor(self.length), 30),
        ]
        shapes = [mix((np.uint64(1000 * k) + np.maximum(np.nan_to_num(f), 0).astype(np.uint64))) for k, f in enumerate(figures, 1)]
        every = np.arange(self.flat.starts.size)
        starts, ends = self.flat.runs(_SYMBOL[self.flat.data])
        text = np.concatenate([self._text_of(self.word_starts), self._text_of(starts), *[every] * len(shapes)])
        hashed = np.concatenate([self.word_hashes, self.flat.hashes(starts, ends), *shapes]) >> np.uint64(64 - HASH_BITS)
        pairs = distinct((text.astype(np.uint64) << np.uint64(HASH_BITS)) | hashed)
        return (pairs >> np.uint64(HASH_BITS)).astype(np.int64), (pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1])


def _answers(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(says bad, says good): only people say good; a rule that is silent, or knows another language, says nothing."""
    good = np.zeros(votes.shape)
    good[:, -1] = votes[:, -1] == 1
    return (votes == 2).astype(float), good


def fit_labellers(counts: dict[int, int], labellers: int) -> tuple[np.ndarray, float]:
    """(how often each labeller says bad: of good texts and of bad ones; share of bad texts).

    ``counts`` holds the documents per vote pattern; the last labeller is people, whose chances are given. A weak prior holds that
    labellers seldom call a good text bad, which also keeps the two classes from changing places. Texts on
    which all are silent count by the share of bad texts, so it is the ratio of the chances that tells.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[code] for code in codes.tolist()], dtype=float)
    votes = codes[:, None] // 3 ** np.arange(labellers) % 3
    says_bad, says_good = _answers(votes)
    judged = votes[:, -1] > 0
    prior = EM_PRIOR * weight.sum()
    chance, bad = np.repeat([[0.01], [0.3]], labellers, axis=1), BAD_SHARE
    chance[:, -1] = PEOPLE
    expected = chance.copy()
    for _ in range(EM_ROUNDS):
        both = says_bad @ np.log(chance).T + says_good @ np.log(1 - chance).T + np.log([1 - bad, bad])
        both = np.exp(both - both.max(axis=1, keepdims=True))
        both *= (weight / both.sum(axis=1))[:, None]
        strength = prior * np.array([[1.0], [0.1]])
        chance = (both.T @ says_bad + strength * expected) / (both.sum(axis=0)[:, None] + strength)
        chance[:, -1] = PEOPLE
        bad = (both[judged, 1].sum() + 100 * BAD_SHARE) / (weight[judged].sum() + 100)
    return chance, float(bad)


def accuracies(model: tuple[np.ndarray, float]) -> np.ndarray:
    """Share of each labeller's bad calls that are right."""
    chance, bad = model
    return bad * chance[1] / (bad * chance[1] + (1 - bad) * chance[0])


def posterior(votes: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Chance that a text with these votes is bad; people's votes are the last column."""
    chance, bad = model
    says_bad, says_good = _answers(votes)
    odds = says_bad @ np.log(chance[1] / chance[0]) + says_good @ np.log((1 - chance[1]) / (1 - chance[0]))
    return 1 / (1 + np.exp(-(odds + np.log(bad / (1 - bad)))))


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, size: int) -> np.ndarray:
    """Weights of a logistic model, the last one for the constant; ``rows`` hold present features."""
    dense = np.zeros((len(rows), size + 1), dtype=np.float32)
    for k, present in enumerate(rows):
        dense[k, present] = 1
    dense[:, -1] = 1
    target = target.astype(np.float32)
    # Either class counts half, so that a rare one is learned.
    weight = np.where(target > 0.5, 0.5 / max(1, (target > 0.5).sum()), 0.5 / max(1, (target <= 0.5).sum())).astype(np.float32)
    weights, speed, seen = (np.zeros(size + 1, dtype=np.float32) for _ in range(3))
    for _ in range(FIT_ROUNDS):
        guess = 1 / (1 + np.exp(-np.clip(dense @ weights, -30, 30)))
        slope = dense.T @ (weight * (guess - target)) + FIT_RIDGE * weights
        speed = 0.9 * speed + slope
        seen += slope * slope
        weights = weights - FIT_RATE * 0.1 * speed / (np.sqrt(seen) + 1e-6)
    return weights


class Scorer:
    """Weights of the chosen hashed features for each question."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray) -> None:
        self.chosen, self.weights = chosen, weights

    def score(self, facts: Facts) -> np.ndarray:
        text, hashed = facts.features()
        table = np.zeros((1 << HASH_BITS, self.weights.shape[0]), dtype=np.float32)
        table[self.chosen] = self.weights[:, :-1].T
        n = facts.flat.starts.size
        sums = np.stack([np.bincount(text, table[hashed, k], minlength=n) for k in range(len(QUESTIONS))], axis=1)
        score = 1 / (1 + np.exp(-np.clip(sums + self.weights[:, -1], -30, 30)))
        score[facts.blank, 0] = 1.0
        return score


def _map(frame: DataFrame, columns: str, work) -> DataFrame:
    """``work(facts) -> arrays`` for every chunk of texts, beside the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                arrays = [pa.array(values) for values in work(Facts(texts))]
                piece = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([piece, *arrays], ["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    return frame.mapInArrow(run, "doc_id long, " + columns)


def _people(labels: DataFrame) -> DataFrame:
    """``doc_id, junk_label, abuse_label``: people's votes per document, coded as the others."""
    vote = lambda bad, good: F.when(F.max(bad) == 1, 2).when(F.max(good) == 1, 1).otherwise(0).cast("long")
    is_one = lambda column, value: (F.col(column) == value).cast("int")
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        vote(is_one("quality", 0), is_one("quality", 1)).alias("junk_label"),
        vote(is_one("toxic", 1), is_one("toxic", 0)).alias("abuse_label"),
    )


def _thinned(rows: DataFrame, wanted: int, total: int) -> DataFrame:
    """``rows`` (``doc_id, mark, n``) with ``copies`` > 0 that add up to about ``wanted`` of ``total``, always the same ones.

    A row that stands n times gives its share of n, rounded up or down by its hash.
    """
    share = min(1.0, wanted / max(1, total))
    chance = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1_000_003)) / 1_000_003
    return rows.withColumn("copies", F.floor(F.col("n") * share + chance).cast("int")).filter("copies > 0")


def train(texts: DataFrame, labels: DataFrame) -> tuple[list[tuple[np.ndarray, float]], Scorer]:
    """Labeller models of both questions and the scorer, from ``doc_id, text`` and ``doc_id, quality, toxic``."""
    sizes = [len(JUNK_LABELLERS), len(ABUSE_LABELLERS)]
    people = checkpointed(_people(labels))
    patterns = _map(texts, "junk long, abuse long", lambda facts: [pattern_codes(v) for v in facts.votes()])
    every = F.coalesce(F.col("junk_label"), F.lit(0)) * 3 ** (sizes[0] - 1), F.coalesce(F.col("abuse_label"), F.lit(0)) * 3 ** (sizes[1] - 1)
    patterns = patterns.join(people, "doc_id", "left").select((F.col("junk") + every[0]).alias("junk"), (F.col("abuse") + every[1]).alias("abuse"))
    found = patterns.groupBy("junk", "abuse").count().collect()  # 3^12 rows at most, a few dozen as a rule
    total = sum(row["count"] for row in found)
    models = []
    for question, size in zip(QUESTIONS, sizes):
        counts: dict[int, int] = {}
        for row in found:
            counts[row[question]] = counts.get(row[question], 0) + row["count"]
        models.append(fit_labellers(counts, size) if counts else (np.full((2, size), 0.5), 0.5))

    # Ids and hashes of texts with their number: null, repeated and equal rows are thinned like others.
    marked = texts.withColumn("mark", F.xxhash64("text"))
    counted = checkpointed(marked.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")))
    known = counted.join(people, "doc_id")
    known = _thinned(known, SAMPLE // 2, known.agg(F.sum("n")).first()[0] or 0)
    zero = F.lit(0).cast("long")
    every = _thinned(counted, SAMPLE // 2, total).withColumns({"junk_label": zero, "abuse_label": zero})
    columns = ["doc_id", "mark", "junk_label", "abuse_label", "copies"]
    keys = checkpointed(known.select(columns).unionByName(every.select(columns)))  # about SAMPLE rows at most
    keys = F.broadcast(keys.withColumnsRenamed({"doc_id": "key_id", "mark": "key_mark"}))
    picked = marked.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("mark") == F.col("key_mark")))
    picked = picked.groupBy(columns).agg(F.first("text").alias("text"))
    picked = picked.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "text", "junk_label", "abuse_label")
    sample = checkpointed(picked.mapInArrow(_labelled(models), "doc_id long, junk double, abuse double, features binary"))
    strength = sample.mapInArrow(_summed, "feature long, n double, junk double, abuse double")
    strength = strength.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *QUESTIONS)])
    base = sample.agg(*[F.avg(q).alias(q) for q in QUESTIONS]).first()
    # How far the share of bad texts with a feature lies from the share at large, in standard deviations.
    tells = [F.abs(F.col(q) - F.col("n") * (base[q] or 0.0)) / F.sqrt("n") / max(base[q] or 0.0, 1e-6) ** 0.5 for q in QUESTIONS]
    top = [
        row["feature"]
        for tell in tells
        for row in strength.filter("n >= 4").orderBy(tell.desc(), "feature").limit(FEATURES // 2).collect()
    ]
    chosen = np.array(sorted(set(top)), dtype=np.int64)
    rows = sample.mapInArrow(_narrowed(chosen), sample.schema).collect()  # about SAMPLE rows of FEATURES numbers at most
    rows.sort(key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, bytes(row["features"]), row["junk"], row["abuse"]))
    present = [np.frombuffer(row["features"], np.int16) for row in rows]
    weights = [fit_scorer(present, np.array([row[q] for row in rows]), chosen.size) for q in QUESTIONS]
    return models, Scorer(chosen, np.stack(weights))


def _labelled(models: list[tuple[np.ndarray, float]]):
    """Posteriors and hashed features of sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            people = [batch.column(k).to_numpy() for k in (2, 3)]
            for start, texts in chunks(batch.column(1).to_pylist()):
                facts = Facts(texts)
                text, hashed = facts.features()
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                bodies = [hashed[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                votes = [np.column_stack([v, p[start : start + len(texts)]]) for v, p in zip(facts.votes(), people)]
                chances = [pa.array(posterior(v, m)) for v, m in zip(votes, models)]
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *chances, pa.array(bodies, pa.binary())], ["doc_id", *QUESTIONS, "features"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature the texts that have it and their posteriors, added up."""
    sums = np.zeros((3, 1 << HASH_BITS))
    for batch in batches:
        for body, *bad in zip(*(batch.column(name).to_pylist() for name in ("features", *QUESTIONS))):
            held = np.frombuffer(body, np.int32)
            sums[:, held] += np.array([[1.0], *[[value] for value in bad]])
    there = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(row[there]) for row in sums]], ["feature", "n", *QUESTIONS])


def _narrowed(chosen: np.ndarray):
    """Rows with the places of the chosen features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for body in batch.column("features").to_pylist():
                held = np.frombuffer(body, np.int32)
                kept.append(np.searchsorted(chosen, held[np.isin(held, chosen)]).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.binary())], batch.schema.names)

    return run


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, weak_junk, weak_abuse, junk, abuse, keep``: posteriors from the rules' votes, scores, decision."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    models, scorer = train(texts, labels)

    def scored(facts: Facts) -> list:
        weak = [posterior(np.pad(v, ((0, 0), (0, 1))), m) for v, m in zip(facts.votes(), models)]
        score = scorer.score(facts)
        return [*weak, score[:, 0], score[:, 1], (score < THRESHOLD).all(axis=1)]

    return _map(texts, "weak_junk double, weak_abuse double, junk double, abuse double, keep boolean", scored)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer doesn't reject, with their columns as they came."""
    models, scorer = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column("text").to_pylist()):
                keep = (scorer.score(Facts(texts)) < THRESHOLD).all(axis=1)
                yield batch.slice(start, len(texts)).filter(pa.array(keep))

    return docs.mapInArrow(kept, docs.schema)
