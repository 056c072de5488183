"""Toxicity by weak supervision.

Voters (lexicon groups, patterns, and groups of words that training labels point to) vote on every
text of the training fold. A generative model of two latent classes is fitted to the counts of
vote patterns by expectation maximisation, with the known labels of the fold held fixed: it gives
each voter's accuracy in either class. Pairs of voters that go together beyond what the classes
explain are correlated; voters linked so form a block, whose joint patterns are counted instead of
each vote alone, and the model is fitted again. A text's posterior under the model, which its votes
alone decide, is the only label that the linear classifier over words is trained on; what words it
uses is chosen by the posteriors too. It scores all texts.

Labels are read only in the fold whose crc32 of the id as text leaves a remainder mod 5: to draw
words for the induced voters, and to estimate the label model. Both the words and the classifier
come from bounded samples of labelled rows; the label model counts all rows of the fold. The label
table, language, source and id are no inputs of a score.

Defined results: a null text counts as empty; an empty text has the score of no evidence; a null
id is in the training fold, has no label and stays null; ids labelled twice take the larger label,
labels that are null none; equal rows count once in a sample; without labels of both kinds the
lexicons alone decide; every row of the input gives one row; texts of any length are read whole;
other columns of either table are left alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import checkpointed, map_batches, read_table

FOLDS = 5
#: Labelled rows that words of voters are drawn from, and labelled rows that train the classifier: at
#: most so many of either class, those with the smallest hashes.
LABELLED_SAMPLE, TRAINING_SAMPLE = 4000, 3000
#: Words and stems that the classifier uses besides the lexicons', the best by posterior, and those
#: that induced voters use, the best by label: sizes of the models, whatever the corpus.
VOCABULARY, INDUCED, INDUCED_VOTERS = 800, 240, 4
#: Lengths of stems; a stem is a longer word's beginning, written with STEM after it.
STEMS, STEM = (4, 5, 6), "-"
#: Surplus of joint votes, over the classes' product, at which two voters are correlated.
CORRELATED = 0.02
#: Correlation over all texts at which two voters are taken for one from the start.
REDUNDANT = 0.85
ROUNDS = 40

# Lexicons of the voters, in lower case.
LEXICONS = {
    "insult_mind": "idiot idiots moron morons stupid dumb imbecile cretin fool dimwit halfwit brainless retard",
    "insult_worth": "loser losers worthless pathetic useless nobody failure scum vermin filth trash garbage parasite",
    "insult_manner": "clown coward creep freak jerk pig swine rat liar hypocrite scumbag",
    "disgust": "disgusting disgrace repulsive revolting vile nasty gross despicable",
    "profanity": "damn crap bastard bitch asshole shit fuck fucking fucker dick prick cunt whore slut",
    "threat": "kill hurt beat destroy murder strangle choke punch",
    "fr": "imbécile crétin connard connasse salaud salope ordure débile abruti minable merde",
    "de": "dummkopf trottel vollidiot arschloch schwein abschaum drecksack miststück scheiße wichser",
    "es": "imbécil estúpido tonto gilipollas cabrón puta escoria basura asqueroso mierda pendejo",
}
PATTERNS = {
    "addressed": r"\b(?:you|u|your|youre|tu|du|eres)\s+(?:\w+\s+){0,3}(?:idiot|moron|loser|scum|trash|clown|stupid|pathetic|worthless|disgusting)",
    "wish": r"\b(?:shut\s+up|get\s+lost|go\s+away|hate\s+you|drop\s+dead|go\s+die)\b",
}
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words and their stems, so that inflected forms meet."""
    out = set(words)
    for n in STEMS:
        out.update({w[:n] + STEM for w in words if len(w) > n})
    return out


class Voters:
    """Each votes 1 on a text or not."""

    def __init__(self, lexicons: dict[str, str], patterns: dict[str, str], induced: list[list[str]]):
        self.lexicons = [frozenset(x.split()) for x in lexicons.values()] + [frozenset(x) for x in induced]
        self.any_word = frozenset().union(*self.lexicons)
        self.patterns = [re.compile(p) for p in patterns.values()]
        self.cues = [frozenset(re.findall(r"[a-z]{3,}", p)) for p in patterns.values()]

    def __call__(self, text: str | None, words: set[str]) -> str:
        hit = features_of(words) & self.any_word
        votes = ["1" if hit and not hit.isdisjoint(x) else "0" for x in self.lexicons]
        for p, cue in zip(self.patterns, self.cues):
            votes.append("1" if not words.isdisjoint(cue) and p.search(text.lower()) else "0")
        return "".join(votes)


class LabelModel:
    """Two latent classes over blocks of binary votes."""

    def __init__(self, blocks: list[list[int]], prior: float = 0.1):
        self.blocks, self.prior = blocks, prior
        self.tables: list[list[dict]] = []

    def _of(self, patterns: list[str], block: list[int]) -> list[str]:
        return ["".join(p[k] for k in block) for p in patterns]

    def fit(self, patterns: list[str], counts: np.ndarray, known: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posteriors of the patterns. known[k] counts pattern k's labelled rows by class; rows
        without a label are the rest. start: first posteriors of those."""
        free = counts - known.sum(axis=1)
        posterior = start
        keys = [self._of(patterns, b) for b in self.blocks]
        for _ in range(ROUNDS):
            mass = np.stack([free * (1 - posterior), free * posterior], axis=1) + known
            total = mass.sum(axis=0)
            self.prior = (total[1] + 1) / (total.sum() + 10)
            self.tables = []
            for key in keys:
                sums: dict[str, np.ndarray] = {}
                for k, m in zip(key, mass):
                    sums[k] = sums.get(k, 0) + m
                size = 2 ** len(key[0])
                self.tables.append([{k: (m[y] + 0.5 / size) / (total[y] + 0.5) for k, m in sums.items()} for y in (0, 1)])
            new = self.posterior(patterns)
            done = np.abs(new - posterior).max(initial=0) < 1e-6
            posterior = new
            if done:
                break
        return posterior

    def posterior(self, patterns: list[str]) -> np.ndarray:
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for block, (no, yes) in zip(self.blocks, self.tables):
            for i, k in enumerate(self._of(patterns, block)):
                odds[i] += np.log(yes.get(k, 1e-6)) - np.log(no.get(k, 1e-6))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _votes(patterns: list[str]) -> np.ndarray:
    return np.array([[c == "1" for c in p] for p in patterns], float)


def _joined(pairs, blocks: list[list[int]], most: int) -> list[list[int]]:
    """Blocks joined along pairs (strength, a, b), the strongest first, while they stay small."""
    for _, a, b in sorted(pairs, reverse=True):
        one, other = next(x for x in blocks if a in x), next(x for x in blocks if b in x)
        if one is not other and len(one) + len(other) <= most:
            blocks = [x for x in blocks if x is not one and x is not other] + [sorted(one + other)]
    return sorted(blocks)


def redundant_blocks(patterns: list[str], counts: np.ndarray, least: float = REDUNDANT, most: int = 4) -> list[list[int]]:
    """Groups of voters that say nearly the same, whatever the class: no class could explain that,
    and apart they would outvote all others."""
    votes, w = _votes(patterns), counts / max(counts.sum(), 1e-9)
    alone = w @ votes
    spread = np.sqrt(alone * (1 - alone))
    phi = ((votes * w[:, None]).T @ votes - np.outer(alone, alone)) / np.maximum(np.outer(spread, spread), 1e-12)
    n = votes.shape[1]
    return _joined([(phi[a, b], a, b) for a in range(n) for b in range(a) if phi[a, b] > least], [[k] for k in range(n)], most)


def correlated_blocks(patterns: list[str], counts: np.ndarray, posterior: np.ndarray, blocks: list[list[int]], least: float = CORRELATED, most: int = 4) -> list[list[int]]:
    """Blocks joined where voters go together beyond the product of what each does in a class."""
    votes = _votes(patterns)
    n = votes.shape[1]
    surplus = np.zeros((n, n))
    for weight in (counts * posterior, counts * (1 - posterior)):
        if weight.sum() > 0:
            w = weight / weight.sum()
            alone = w @ votes
            surplus = np.maximum(surplus, np.abs((votes * w[:, None]).T @ votes - np.outer(alone, alone)))
    return _joined([(surplus[a, b], a, b) for a in range(n) for b in range(a) if surplus[a, b] > least], blocks, most)


def fit_linear(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1.0, steps: int = 25) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression on binary features, by Newton's method."""
    x = np.zeros((len(rows), size + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, [k + 1 for k in r]] = 1
    penalty = np.full(size + 1, ridge)
    penalty[0] = 1e-3
    beta = np.zeros(size + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        beta -= move * min(1.0, 4 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return float(beta[0]), beta[1:]


def remainder(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(1))


def _words_by_label(rows: DataFrame) -> DataFrame:
    """(word, toxic, n): texts of the sample that hold a word, summed by task, then over tasks."""

    def setup():
        def kernel(texts, labels):
            seen = Counter((w, y) for t, y in zip(texts, labels) for w in features_of(words_of(t)))
            return [[w for w, _ in seen], [y for _, y in seen], list(seen.values())]

        return kernel

    return map_batches(rows, ["_text", "_toxic"], "word STRING, toxic INT, n LONG", setup).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("no")
    )


def _sampled(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of either class, those with the smallest hashes: a bounded fitting sample."""
    first = [rows.where(f"{label} = {y}").orderBy(F.xxhash64("_id", "_row"), "_id", "_row").limit(most) for y in (1, 0)]
    return first[0].unionByName(first[1])


def _pointed_words(table: DataFrame, yes: int, no: int, most: int) -> list:
    """The words that tell `yes` texts from `no` others best, with their log ratio of rates (lift)."""
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    lift = F.log(rate("yes", yes) / rate("no", no))
    gain = (rate("yes", yes) - rate("no", no)) * lift
    return table.withColumn("gain", gain).withColumn("lift", lift).orderBy(F.desc("gain"), "word").limit(most).collect() if yes and no else []


class Model:
    """A fitted classifier and the label model that taught it."""

    def __init__(self, intercept: float, weights: dict[str, float], voters: list[str], accuracies: dict, blocks: list):
        self.intercept, self.weights, self.voters, self.accuracies, self.blocks = intercept, weights, voters, accuracies, blocks

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[w] for w in sorted(features_of(words_of(text)) & self.weights.keys()))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    train = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).where(remainder("_id") != 0).withColumn("_row", F.xxhash64("_text"))
    of_sample = lambda sample: train.join(F.broadcast(sample), ["_id", "_row"]).dropDuplicates(["_id", "_row"])  # noqa: E731  bounded rows
    sizes = lambda sample, label: {r[label]: r["n"] for r in sample.groupBy(label).agg(F.count("*").alias("n")).collect()}

    # words that the training labels point to, from a bounded sample of labelled rows
    sample = checkpointed(_sampled(train.select("_id", "_row").join(known, "_id").distinct(), "_toxic", LABELLED_SAMPLE))
    n = sizes(sample, "_toxic")
    yes, no = n.get(1, 0), n.get(0, 0)
    by_label = _pointed_words(_words_by_label(of_sample(sample)), yes, no, VOCABULARY)
    pointed = [r["word"] for r in by_label if r["lift"] > 2 and r["yes"] >= max(3, 0.004 * yes)][:INDUCED]
    induced = [pointed[k::INDUCED_VOTERS] for k in range(INDUCED_VOTERS)]
    names = [*LEXICONS, *(f"induced_{k}" for k in range(INDUCED_VOTERS)), *PATTERNS]

    def setup():
        voters = Voters(LEXICONS, PATTERNS, induced)

        return lambda ids, rows, texts: [ids, rows, [voters(t, words_of(t)) for t in texts]]

    kind = dict(docs.dtypes)[id_col]
    voted = checkpointed(map_batches(train, ["_id", "_row", "_text"], f"_id {kind}, _row LONG, _votes STRING", setup).join(known, "_id", "left"))
    # at most one row for each vote pattern that occurs, whatever the number of texts
    tally = voted.groupBy("_votes").agg(F.count("*").alias("n"), F.count_if(F.col("_toxic") == 0).alias("no"), F.count_if(F.col("_toxic") == 1).alias("yes")).orderBy("_votes").collect()
    patterns = [r["_votes"] for r in tally]
    counts = np.array([r["n"] for r in tally], float)
    marked = np.array([[r["no"], r["yes"]] for r in tally], float).reshape(-1, 2)
    start = np.array([0.9 if "1" in p else 0.02 for p in patterns])
    posterior, blocks = start, []
    if patterns:
        blocks = redundant_blocks(patterns, counts)
        posterior = LabelModel(blocks).fit(patterns, counts, marked, start)
        blocks = correlated_blocks(patterns, counts, posterior, blocks)
        model = LabelModel(blocks)
        posterior = model.fit(patterns, counts, marked, posterior)
    votes = _votes(patterns).reshape(-1, len(names))
    weighed = lambda w: (w @ votes / max(w.sum(), 1e-9)).tolist()
    accuracies = {n: (a, b) for n, a, b in zip(names, weighed(counts * posterior), weighed(counts * (1 - posterior)))}

    # the linear classifier, on the posteriors of a bounded sample of labelled rows
    spark = docs.sparkSession
    by_pattern = spark.createDataFrame([(p, float(q), int(q >= 0.5)) for p, q in zip(patterns, posterior)] or [], "_votes STRING, _p DOUBLE, _guess INT")
    judged = voted.where("_toxic IS NOT NULL").join(F.broadcast(by_pattern), "_votes").select("_id", "_row", "_p", "_guess").distinct()  # at most 2 ** voters patterns
    learning = checkpointed(_sampled(judged, "_guess", TRAINING_SAMPLE))
    n = sizes(learning, "_guess")
    guessed = _words_by_label(of_sample(learning).withColumnRenamed("_guess", "_toxic"))
    vocabulary = sorted({r["word"] for r in _pointed_words(guessed, n.get(1, 0), n.get(0, 0), VOCABULARY)} | {w for x in LEXICONS.values() for w in x.split()})
    place = {w: k for k, w in enumerate(vocabulary)}

    def features():
        def kernel(texts, ps):
            return [ps, [sorted(place[w] for w in features_of(words_of(t)) & place.keys()) for t in texts]]

        return kernel

    rows = map_batches(of_sample(learning), ["_text", "_p"], "p DOUBLE, on ARRAY<INT>", features).orderBy("p", "on").collect()
    target = np.array([r["p"] for r in rows])
    guess = posterior >= 0.5
    # the sample has at most so many of either class: others weigh so that both count as in the fold
    share = counts[~guess].sum() / max(1.0, counts[guess].sum()) * n.get(1, 0) / max(1, n.get(0, 0)) if patterns else 1.0
    weight = np.where(target >= 0.5, 1.0, min(4.0, max(1.0, share)))
    if yes and no and n.get(1) and n.get(0):
        intercept, beta = fit_linear([r["on"] for r in rows], target, weight, len(vocabulary))
    else:  # nothing to learn from: any word of the lexicons decides
        intercept, beta = -2.0, np.full(len(vocabulary), 3.0)
    return Model(intercept, {w: float(b) for w, b in zip(vocabulary, beta)}, names, accuracies, [[names[k] for k in b] for b in blocks if len(b) > 1])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of docs."""

    def setup():
        return lambda ids, texts: [ids, [model.score(t) for t in texts]]

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, score DOUBLE", setup)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fitted(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
