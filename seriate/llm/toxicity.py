"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all from its own characters: densities of a lexicon, hits near a second-person word, capitals, punctuation and
obfuscated words. The lexicon has a small fixed part and a learnt one: word stems that labelled toxic texts hold far more often than
others. Trees, lexicon and calibration are fitted on a bounded sample of labelled rows outside the held-out fold; the trees see each
sample row through a lexicon learnt from the other folds. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of

#: The bound of the sample of labelled rows that the model is fitted on, and the folds of its lexicons.
SAMPLE_ROWS, FOLDS = 20_000, 4
#: A stem enters the lexicon if this many times likelier in toxic texts, with this log-likelihood ratio at least, and if this many toxic
#: texts hold it; at most so many stems, chosen from as many candidates at most.
LIFT, LEAST_RATIO, LEAST_TEXTS, LEXICON_SIZE, CANDIDATES = 6.0, 14.0, 4, 2_000, 20_000
#: Counts that a task gathers before it hands them on.
COUNTED = 50_000
#: Words around a second-person word within which a hit counts as aimed at the reader.
NEAR = 6

#: Second-person words of the languages covered, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split())
INSULTS = frozenset("asshole bastard bitch clown coward creep crap cretin damn disgusting dumb dumbass filth fool freak garbage hate idiot imbecile jerk liar loser lowlife moron parasite pathetic pig rat retard scum shit shut stupid trash ugly useless vermin worthless".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

FEATURES = ["fixed_per_100", "log_fixed", "hits_per_100", "distinct_per_100", "log_hits", "log_distinct", "near_second_person", "disguised_hits", "capitals", "shouted_words", "punctuation", "exclamations", "obfuscated", "log_words"]

_WORD = re.compile(r"\S+")
_EDGE = " \t\n\r\f\v.,;:!?\"'()[]{}<>|-–—…«»„“”¿¡#%&^~`/\\"
_ODD = re.compile(r"[^\W\d_][\d@$*!]+[^\W_]|[\d@$*][^\W\d_]")
_SHOUT = re.compile(r"\b[^\W\d_a-zà-öø-ÿ]{3,}\b")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[^\w\s]")


def stems(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to six letters: endings vary."""
    return (word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) >= k))


def _hit(bare: str, lexicon: frozenset[str]) -> int:
    """2 for a fixed insult (or its plural), 1 for a learnt stem, else 0."""
    if bare in INSULTS or bare[-1:] == "s" and bare[:-1] in INSULTS:
        return 2
    return int(any(s in lexicon for s in stems(bare)))


def features(text: str, lexicon: frozenset[str], known: dict[str, int]) -> list[float]:
    """The dense features of a text, in the order of FEATURES; ``known`` keeps which words are hits."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    for w in set(tokens):
        if w not in known:
            bare = w.strip(_EDGE)
            hit = _hit(bare, lexicon) if bare else 0
            if not hit and bare and not bare.isalpha():
                plain = bare.translate(LEET)
                hit = _hit(plain, lexicon) if plain != bare and len(plain) >= 4 else 0
            known[w] = hit
    hits = [i for i, w in enumerate(tokens) if known[w]]
    fixed = sum(known[tokens[i]] == 2 for i in hits)
    distinct = len({tokens[i].strip(_EDGE) for i in hits})
    near = disguised = 0
    for i in hits:
        disguised += not tokens[i].strip(_EDGE).isalpha()
        near += any(w.strip(_EDGE) in SECOND_PERSON for w in tokens[max(0, i - NEAR) : i + NEAR + 1])
    chars = len(text)
    return [
        100.0 * fixed / n,
        float(np.log1p(fixed)),
        100.0 * len(hits) / n,
        100.0 * distinct / n,
        float(np.log1p(len(hits))),
        float(np.log1p(distinct)),
        100.0 * near / n,
        100.0 * disguised / n,
        len(_CAPITAL.findall(text)) / chars,
        len(_SHOUT.findall(text)) / n,
        len(_PUNCTUATION.findall(text)) / chars,
        text.count("!") / chars,
        len(_ODD.findall(text)) / n,
        float(np.log1p(n)),
    ]


def chosen_stems(counts: np.ndarray, terms: list[str], totals: np.ndarray) -> frozenset[str]:
    """The lexicon from how many (clean, toxic) texts hold each term, and how many texts there are of either kind."""
    clean, toxic = counts[:, 0], counts[:, 1]
    lift = ((toxic + 0.5) / (totals[1] + 1)) / ((clean + 0.5) / (totals[0] + 1))
    share = totals[1] / max(1, totals.sum())
    both = clean + toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0))
    good = np.flatnonzero((lift >= LIFT) & (toxic >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
    order = sorted(good.tolist(), key=lambda k: (-ratio[k], terms[k]))
    return frozenset(terms[k] for k in order[:LEXICON_SIZE])


def _counted(found: Counter) -> pa.RecordBatch:
    terms, cells = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(cells, pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "cell", "n"])


def learn_lexicons(sample: DataFrame) -> list[frozenset[str]]:
    """Stems that toxic texts of the sample (text, label, fold) hold far more often: without each fold, and, last, of all folds."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                own = {s for w in set((text or "").lower().split()) if (bare := w.strip(_EDGE)) for s in stems(bare)}
                found.update([(s, 2 * fold + label) for s in own])
                if len(found) > COUNTED:
                    yield _counted(found)
                    found.clear()
        if found:
            yield _counted(found)

    totals = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        totals[r["fold"], r["label"]] = r["n"]
    counted = sample.select("text", "label", "fold").mapInArrow(count, "term string, cell int, n long").groupBy("term")
    cells = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS)]
    toxic, clean = (sum((F.col(f"c{2 * k + label}") for k in range(1, FOLDS)), F.col(f"c{label}")) for label in (1, 0))
    top = counted.agg(*cells).where((toxic >= LEAST_TEXTS) & (toxic * max(1.0, totals[:, 0].sum()) >= LIFT / 2 * clean * max(1.0, totals[:, 1].sum())))
    rows = top.orderBy(toxic.desc(), "term").limit(CANDIDATES).collect()  # at most CANDIDATES terms
    terms = [r["term"] for r in rows]
    counts = np.array([[r[f"c{k}"] for k in range(2 * FOLDS)] for r in rows], dtype=float).reshape(-1, FOLDS, 2)
    parts = [np.arange(FOLDS) != k for k in range(FOLDS)] + [np.ones(FOLDS, bool)]
    return [chosen_stems(counts[:, p].sum(1), terms, totals[p].sum(0)) for p in parts]


def with_features(df: DataFrame, lexicons: list[frozenset[str]], keep: list[str], text_col: str = "text", fold_col: str | None = None) -> DataFrame:
    """The kept columns and the dense features of every whole text, under the lexicon of its fold or else the last one."""
    shared = df.sparkSession.sparkContext.broadcast(lexicons)  # at most LEXICON_SIZE stems each
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{f} double" for f in FEATURES)])
    width = len(keep)

    def run(batches):
        known: dict[int, dict[str, int]] = {k: {} for k in range(-1, FOLDS)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, folds = part.column(width).to_pylist(), part.column(width + 1).to_pylist()
                rows = np.array([features(t or "", shared.value[k], known[k]) for t, k in zip(texts, folds)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(width)), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], [*keep, *FEATURES])
                for own in known.values():
                    if len(own) > 100_000:
                        own.clear()

    fold = F.col(fold_col) if fold_col else F.lit(-1)
    return texts_of(df, *keep, df[text_col].alias("_text"), fold.cast("int").alias("_fold")).mapInArrow(run, schema)


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``score`` applies them to any table with texts."""

    def __init__(self, lexicons, trees, calibration, prior: float):
        self.lexicons, self.trees, self.calibration, self.prior = lexicons, trees, calibration, prior

    def score(self, df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """The kept columns and ``score`` of every row; a null text counts as empty."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.prior).cast("double").alias("score"))
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        named = {c: f"_kept{k}" for k, c in enumerate(keep)}  # whatever the kept columns are called, they clash with no feature
        rows = with_features(df.select(df[text_col].alias("_whole"), *(df[c].alias(n) for c, n in named.items())), self.lexicons, list(named.values()), "_whole")
        raw = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)).withColumn("_raw", vector_to_array("probability")[1])
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score")))
        return self.calibration.transform(raw).select(*(F.col(n).alias(c) for c, n in named.items()), score.alias("score"))


def held_out(id_col: str = "doc_id"):
    """The fold that no label is learnt from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold: those with the least hash of their id.

    Where a label has no rows the model is a constant: the share of toxic rows, or 0 without any. Rows with null labels don't count;
    of repeated labels of one document each counts.
    """
    # Imported here, as Python workers import this module and need none of it.
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    chosen = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # Bounded by ``rows``: ids and labels only.
    sample = staged(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel([], None, None, 1.0 if 1 in totals else 0.0)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = sample.withColumn("fold", fold)
    lexicons = learn_lexicons(sample)
    rows_ = staged(with_features(sample, lexicons, ["doc_id", "label"], fold_col="fold"), "toxicity-features")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows_.withColumn("label", F.col("label").cast("double")))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("trees")), F.lit(10))
    trees_rows, calibration_rows = assembled.where(part < 7), assembled.where(part >= 7)
    if any(x.select("label").distinct().count() < 2 for x in (trees_rows, calibration_rows)):
        trees_rows = calibration_rows = assembled
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_predicted", maxIter=15, maxDepth=3, stepSize=0.3, seed=7)
    model = trees.fit(trees_rows)
    raw = model.transform(calibration_rows).withColumn("_raw", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_score").fit(raw)
    return ToxicityModel(lexicons, model, calibration, totals.get(1, 0) / sum(totals.values()))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; repeated rows give repeated results."""
    scored = fit(documents, labels).score(documents, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
