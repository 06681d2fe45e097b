"""Toxicity: boosted trees over densities of a learned lexicon and features of form, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import packed, scratch, unpacked

# Labelled rows that the lexicon, the trees and the calibration are fitted on.
SAMPLE = 30_000
# Entries of the lexicon, and the toxic texts that an entry must be in.
ENTRIES, SUPPORT = 20_000, 4
# Letters of the word beginnings that the lexicon may hold besides words.
STEMS = range(4, 9)
# Log odds from which an entry is in the lexicon, and from which it is strong.
WEAK, STRONG = 1.5, 3.0
FOLDS = 4
# Words between a lexicon word and a second person that still count as near.
NEAR = 5
# Words that a task remembers, and counts that it gathers.
REMEMBERED = 50_000
BUCKETS = 4_096

# Second persons of English, German, French and Spanish, and signs that stand for letters: fixed values.
SECOND_PERSON = frozenset(
    """you your yours yourself you're youre u ur du dich dir dein deine deinen ihr euch euer
    tu te toi ton ta tes vous votre vos tú ti usted ustedes""".split()
)
SIGNS = str.maketrans("013457@$!", "oieastasi")

FEATURES = (
    "log_words",
    "weak_density",
    "strong_density",
    "log_hits",
    "log_distinct_hits",
    "odds_density",
    "greatest_odds",
    "near_second_person",
    "second_person_rate",
    "shouted_words",
    "capitals",
    "exclamations",
    "punctuation",
    "digits",
    "obfuscated_words",
    "obfuscated_hits",
    "different_words",
)
_COLUMNS = ("odds", "weak", "strong", "second", "shouted", "capital", "cry", "sign", "digit", "hidden", "hidden_hit", "size")
_INNER = re.compile(r"[^\W_]+(?:[\W_]+[^\W_]+)*")
_REPEATED = re.compile(r"(.)\1{2,}")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _plain(core: str) -> str:
    """A lower-case word with signs read as letters, other signs left out and repeated letters once."""
    if not core.isalpha():
        if not any(map(str.isalpha, core)):
            return core
        core = _NOT_LETTER.sub("", core.translate(SIGNS))
    return _REPEATED.sub(r"\1", core)


def _terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _core(token: str) -> str:
    """The token from its first to its last letter or digit, in lower case."""
    if token.isalpha():
        return token.lower()
    if token[:-1].isalpha() and not token[-1].isdigit():
        return token[:-1].lower()
    found = _INNER.search(token)
    return found.group().lower() if found else ""


class Reader:
    """Features of texts with one lexicon (term: log odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        # How the entries begin: a word that begins otherwise is not among them.
        self._heads = {term[: STEMS[0]] for term in lexicon} | {term for term in lexicon if len(term) < STEMS[0]}
        self._known: dict[str, int] = {}
        # Words outside of the lexicon share the row of their values.
        self._shared: dict[tuple, int] = {}
        self._rows: list[tuple] = []
        self._table = np.empty((0, len(_COLUMNS)))

    def _odds(self, word: str) -> float:
        if word[: STEMS[0]] not in self._heads:
            return 0.0
        return max(self.lexicon.get(t, 0.0) for t in _terms(word))

    def _look(self, token: str) -> int:
        """The row of the token's values, which is added if it is a new one."""
        core = _core(token)
        plain = _plain(core)
        odds, read = self._odds(core), self._odds(plain) if plain != core else 0.0
        best = max(odds, read)
        size = len(token)
        if token.isalpha():
            letters, digits = size, 0
        else:
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        capitals = 0 if token.islower() else sum(map(str.isupper, token))
        hidden = plain != core and any(map(str.isalpha, core))
        values = (
            best,
            WEAK <= best,
            STRONG <= best,
            core in SECOND_PERSON,
            letters >= 3 and capitals == letters,
            capitals,
            token.count("!"),
            size - letters - digits,
            digits,
            hidden,
            hidden and read >= WEAK > odds,
            size,
        )
        row = None if best else self._shared.get(values)
        if row is None:
            row = len(self._rows)
            self._rows.append(values)
            if not best:
                self._shared[values] = row
        self._known[token] = row
        return row

    def _spelled(self, tokens: list[str]) -> list[str]:
        """Words written as single letters, four at least, one after another."""
        found, letters = [], []
        for token in [*tokens, "--"]:
            if len(token) == 1 and token.isalpha():
                letters.append(token.lower())
                continue
            if len(letters) >= 4:
                found.append("".join(letters))
            letters = []
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self._known) > REMEMBERED:
            self._known.clear()
            self._shared.clear()
            self._rows, self._table = [], self._table[:0]
        known, look = self._known, self._look
        ids = np.array([known[t] if t in known else look(t) for t in tokens])
        if len(self._table) < len(self._rows):
            fresh = np.array(self._rows[len(self._table) :], np.float64)
            self._table = np.concatenate((self._table, fresh))
        rows = self._table[ids]
        total = dict(zip(_COLUMNS, rows.sum(axis=0).tolist()))
        hits = np.flatnonzero(rows[:, 1])
        persons = np.flatnonzero(rows[:, 3])
        near = 0
        if len(hits) and len(persons):
            right = np.searchsorted(persons, hits)
            after = np.where(right < len(persons), persons[np.minimum(right, len(persons) - 1)] - hits, n)
            before = np.where(right > 0, hits - persons[np.maximum(right - 1, 0)], n)
            near = int((np.minimum(after, before) <= NEAR).sum())
        spelled = 0
        if total["size"] < 3 * n:  # without short words there are no spelled ones
            spelled = sum(self._odds(w) >= WEAK for w in self._spelled(tokens))
        size = total["size"]
        return [
            math.log1p(n),
            100 * (total["weak"] + spelled) / n,
            100 * (total["strong"] + spelled) / n,
            math.log1p(len(hits) + spelled),
            math.log1p(len(np.unique(ids[hits])) + spelled),
            float(rows[hits, 0].sum()) / n,
            float(rows[:, 0].max()),
            near / len(hits) if len(hits) else 0.0,
            total["second"] / n,
            total["shouted"] / n,
            total["capital"] / size,
            total["cry"] / n,
            total["sign"] / size,
            total["digit"] / size,
            total["hidden"] / n,
            100 * (total["hidden_hit"] + spelled) / n,
            len(set(tokens)) / n,
        ]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each fold and label the words and beginnings are, in parts to be summed."""
    found: dict[tuple, int] = {}

    def counted() -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))]
        arrays.append(pa.array(list(found.values()), pa.int64()))
        found.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["term", "fold", "toxic", "n"])

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))):
            seen: set[str] = set()
            for token in set((text or "").split()):
                core = _core(token)
                for word in {core, _plain(core)}:
                    if len(word) > 1:
                        seen.update(_terms(word))
            for term in seen:
                found[term, fold, toxic] = found.get((term, fold, toxic), 0) + 1
            if len(found) >= REMEMBERED:
                yield counted()
    yield counted()


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """How much likelier a toxic text holds the term, in logs, smoothed by a half."""
    return math.log((toxic + 0.5) * (all_clean + 1) / ((clean + 0.5) * (all_toxic + 1)))


def learn_lexicon(sample: DataFrame) -> list[dict[str, float]]:
    """Terms that toxic texts hold far oftener: one lexicon without each fold's texts, and one of all.

    Rows of ``sample`` have ``text``, ``fold`` and ``toxic``. ``ENTRIES`` terms at most come to the driver.
    """
    cell = [(f"n{k}_{y}", k, y) for k in range(FOLDS) for y in (0, 1)]
    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(c) for c, k, y in cell]
    sizes = sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).agg(*sums).first().asDict()
    sizes = {c: sizes[c] or 0 for c, _, _ in cell}
    whole = {y: sum(sizes[c] for c, _, label in cell if label == y) for y in (0, 1)}
    counted = sample.select("text", "fold", "toxic").mapInArrow(_count_terms, "term string, fold int, toxic int, n bigint")
    terms = counted.groupBy("term").agg(*sums)
    toxic, clean = (sum((F.col(c) for c, _, y in cell if y == label), F.lit(0)) for label in (1, 0))
    odds = F.log((toxic + 0.5) * (whole[0] + 1) / ((clean + 0.5) * (whole[1] + 1)))
    chosen = terms.where((toxic >= SUPPORT) & (odds >= WEAK)).orderBy(F.desc(toxic * odds), "term").limit(ENTRIES).collect()

    lexicons = []
    for left_out in [*range(FOLDS), None]:
        kept = [(c, y) for c, k, y in cell if k != left_out]
        size = {label: sum(sizes[c] for c, y in kept if y == label) for label in (0, 1)}
        lexicon = {}
        for row in chosen:
            count = {label: sum(row[c] for c, y in kept if y == label) for label in (0, 1)}
            odds_here = log_odds(count[1], count[0], size[1], size[0])
            if count[1] >= SUPPORT - 1 and odds_here >= WEAK:
                lexicon[row.term] = odds_here
        lexicons.append(lexicon)
    return lexicons


def _features(shared, carried: str):
    """Features of each text, read with the lexicon that its ``fold`` was left out of; of all without fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(lexicon) for lexicon in shared.value]
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            found = [readers[-1 if f is None else f].features(t) for t, f in zip(texts, folds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(carried), batch.column("fold"), pa.array(found, pa.list_(pa.float64()))],
                names=[carried, "fold", "features"],
            )

    return run


def _sample(labels: DataFrame, key: str, label: str, learn_from: Column, rows: int) -> DataFrame:
    """At most ``rows`` keys with their label: those whose hashes fall below the highest bound that allows it."""
    known = labels.select(F.col(f"`{key}`").cast("bigint").alias("_key"), F.col(f"`{label}`").cast("int").alias("toxic"))
    known = known.where("_key is not null and toxic in (0, 1)").where(learn_from)
    known = known.groupBy("_key").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
    sizes = {r._bucket: r.n for r in known.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = bound = 0
    while bound < BUCKETS and total + sizes.get(bound, 0) <= rows:
        total += sizes.get(bound, 0)
        bound += 1
    return known.where(F.col("_bucket") < bound).drop("_bucket")


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, rows: DataFrame) -> Column | DataFrame:
        """``rows`` (with ``features``) with ``score``."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.share))
        return self.calibration.transform(_raw(self.trees, rows)).drop("features", "raw")


def _raw(trees, rows: DataFrame) -> DataFrame:
    """The trees' probability of the label 1 as ``raw``."""
    given = rows.withColumn("features", array_to_vector("features"))
    found = trees.transform(given).withColumn("raw", vector_to_array("probability")[1])
    return found.drop("probability", "rawPrediction", "prediction")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    learn_from: Column | None = None,
    rows: int = SAMPLE,
    rounds: int = 20,
    depth: int = 4,
) -> Model:
    """Fit the model on a sample of at most ``rows`` labelled documents of those that ``learn_from`` allows.

    ``learn_from`` is a condition on the integer column ``_key``. Equal texts count once, with the
    greater label. Each text's features are read with a lexicon learned without its fold, so the
    densities that the trees learn from are those of texts that the lexicon has not seen. The
    calibration is fitted on what trees of one half of the folds say of the other. Without texts of
    both labels every score is the share of toxic ones.
    """
    learn_from = F.lit(True) if learn_from is None else learn_from
    chosen = _sample(labels, key, label, learn_from, rows)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    store = scratch(docs, "toxicity")
    # The sample's keys are bounded by ``rows``.
    found = texts.join(F.broadcast(chosen), "_key").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = store.save(found.withColumn("fold", F.pmod(F.crc32("text"), F.lit(FOLDS)).cast("int")), "sample")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, None, None, float(1 in counts))

    lexicons = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    read = sample.mapInArrow(_features(shared, "toxic"), "toxic int, fold int, features array<double>")
    # One sorted file, of a bounded number of rows: the trees do not depend on how the texts were dealt.
    rows_read = store.save(read.repartition(1).sortWithinPartitions("fold", "toxic", "features"), "features")
    rows_read = rows_read.withColumn("label", F.col("toxic").cast("double"))
    grower = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, maxMemoryInMB=64, seed=7)

    def grow(part: DataFrame):
        return grower.fit(part.withColumn("features", array_to_vector("features")))

    trees, half = grow(rows_read), FOLDS // 2
    first, second = rows_read.where(F.col("fold") < half), rows_read.where(F.col("fold") >= half)
    if all(part.select("label").distinct().count() == 2 for part in (first, second)):
        judged = _raw(grow(first), second).unionByName(_raw(grow(second), first))
    else:
        judged = _raw(trees, rows_read)
    judged = store.save(judged.select("raw", "label"), "judged")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(judged)
    return Model(lexicons[-1], trees, calibration, counts[1] / sum(counts.values()))


def score_texts(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs``, without its text, with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``).

    Whole texts are read. Null and empty texts have zero for every feature, and their score; equal
    texts have equal scores; repeated rows are scored each; an empty table gives no rows; columns with
    the added names are replaced. Nothing is shuffled; the model is bounded by ``ENTRIES`` and its trees.
    """
    kept = [c for c in docs.columns if c != text]
    rows = packed(docs).select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.lit(None).cast("int").alias("fold"),
        F.col(f"given.`{text}`").alias("text"),
    )
    out = rows.select("row", "fold", F.array(F.lit(0.0)).alias("features"))
    shared = docs.sparkSession.sparkContext.broadcast([model.lexicon])
    scored = model.score(rows.mapInArrow(_features(shared, "row"), out.schema))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return unpacked(scored, kept, score=score, predicted=(score >= threshold).cast("int"))
