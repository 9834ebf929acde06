"""A quality classifier by weak labels.

Eleven overlapping heuristic labellers vote *clean*, *junk*, *abusive* or abstain. Expectation-maximisation
over the counts of vote patterns (at most ``4 ** 11`` rows, a few hundred in practice) estimates how often each labeller
says what in each class, and so a posterior for every pattern. A linear softmax
scorer on hashed features is then trained on the posteriors of ``SAMPLE``
documents, and scores every document. The vote patterns and the features come from all of a text.

Two labellers read a list of abuse in four languages, a third knows nothing of it: its words are learnt from documents that are
labelled toxic or not (``learn_abuse``). Without such labels it abstains.

Bounds: the scorer's training sample is one row of each of the ``SAMPLE`` ids of least hash, words are learnt from one row of each
of the ``LABELLED`` labelled ids of least hash. Votes, posteriors and scores cover all rows.

A null, empty or wordless text has no features; it is scored by the intercept alone and
counts as clean unless the intercept says otherwise. Repeated rows get the same score each; of rows that repeat an id the samples
hold the longest text. Labels may be null, repeated (toxic in one row is toxic) or of no document. An empty
table gives no rows and trains nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, extended, hashed_words, mixed, range_hashes, shingles

CLASSES = ["clean", "junk", "abusive"]
CLEAN, JUNK, ABUSIVE = range(3)
ABSTAIN = 3
#: Documents the scorer is trained on.
SAMPLE = 4_000
TRUST = 0.1
#: Hashed features: two signed buckets a word, and the shape features before them.
BUCKETS = 1 << 18
SHAPES = 128
#: Labelled documents that words of abuse are learnt from; least share of a word's contexts that are toxic, and the chance
#: of learning any word where none is abuse.
LABELLED = 4_000
TOXIC_SHARE = 0.9
CHANCE = 1e-6
# Words of abuse in English, German, French and Spanish, lower case, by the endings they take.
INSULTS = {
    ("", "s"): [
        "asshole", "bastard", "bitch", "clown", "cretin", "dimwit", "dirtbag", "douchebag", "dumbass", "halfwit", "idiot",
        "imbecile", "jerk", "loser", "moron", "nitwit", "retard", "scumbag", "weirdo",
        "connard", "connasse", "débile", "imbécile", "minable", "ordure", "pathétique", "salaud", "salope", "stupide",
        "asquerosa", "asqueroso", "despreciable", "escoria", "estúpida", "estúpido", "gilipollas", "idiota", "patética", "patético",
        "payaso", "pendejo",
    ],
    ("", "ly"): ["brainless", "disgusting", "dumb", "filthy", "gutless", "idiotic", "moronic", "pathetic", "spineless", "stupid", "worthless"],
    ("", "e", "en", "er", "es"): ["dämlich", "erbärmlich", "widerlich", "wertlos", "mistkerl", "vollidiot"],
    ("", "en", "n"): ["depp", "idiot", "schlampe", "trottel", "versager", "wichser"],
    ("", "e", "es", "s"): ["abruti", "crétin", "dégoûtant", "idiot"],
    ("", "es"): ["imbécil", "inútil", "cabron"],
    ("",): [
        "abschaum", "arschloch", "arschlöcher", "basura", "blödmann", "cabrón", "drecksack", "dummkopf", "dummköpfe", "hurensohn",
        "pourriture", "raclure", "schwachkopf", "scum", "stupidity", "trash",
    ],
}
# Signs that prose hardly uses.
SIGNS = "#*$%&|<>{}[]\\^~=_"
LABELLERS = [
    "signs", "capitals", "shouting", "stutter", "same_lines", "letters", "bare_signs", "same_passages", "insults", "insult_rate",
    "learnt",
]

UPPER, LOWER, DIGIT, SIGN, MARK, OTHER = 1, 2, 4, 8, 16, 32


@lru_cache(1)
def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for code in range(128):
        c = chr(code)
        kinds[code] = (
            UPPER if c.isupper() else LOWER if c.islower() else DIGIT if c.isdigit() else SIGN if c in SIGNS else MARK if c == "!" else 0
        )
    return kinds


@lru_cache(1)
def _insult_hashes() -> np.ndarray:
    words = [(stem + ending).encode() for endings, stems in INSULTS.items() for stem in stems for ending in endings]
    length = np.array([len(w) for w in words])
    ends = np.cumsum(length + 1) - 1
    return np.unique(range_hashes(np.frombuffer(b" ".join(words), np.uint8), ends - length, ends, fold=True))


NOTHING = np.zeros(0, np.uint64)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is one of ``known``, which rise."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class Blocks:
    """Per-word facts of a block of texts, and sums of them by text. ``learnt`` holds hashes of learnt words, rising."""

    def __init__(
        self, data: np.ndarray, hashes: np.ndarray, cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray, learnt: np.ndarray = NOTHING
    ):
        self.cuts, self.hashes = cuts, hashes
        low = int(starts[0])
        piece = data[low : int(ends[-1])]
        self.starts, self.ends = starts - low, ends - low
        kinds = _byte_kinds()[piece]
        # characters, not bytes: continuation bytes do not count
        head = (piece & 0xC0) != 0x80
        count = {k: self._by_word(kinds == k) for k in (UPPER, LOWER, DIGIT, SIGN, MARK)}
        self.chars = self._by_word(head)
        self.wide = self._by_word((kinds == OTHER) & head)
        self.upper, self.lower, self.digits, self.signs, self.marks = (count[k] for k in (UPPER, LOWER, DIGIT, SIGN, MARK))
        n = len(hashes)
        first = np.zeros(n, bool)
        first[cuts[:-1][cuts[:-1] < n]] = True
        self.first = first
        self.same = np.append(False, hashes[1:] == hashes[:-1]) & ~first
        # the word without marks around it, A-Z as a-z
        left, right = self.starts.copy(), self.ends.copy()
        solid = (kinds == UPPER) | (kinds == LOWER) | (kinds == DIGIT) | (kinds == OTHER)
        for _ in range(3):
            left += ~solid[np.minimum(left, len(piece) - 1)] & (left < right - 1)
            right -= ~solid[right - 1] & (right - 1 > left)
        self.bare = range_hashes(piece, left, right, fold=True)
        self.insult = _among(self.bare, _insult_hashes())
        self.taught = len(learnt) > 0
        self.learnt = _among(self.bare, learnt)
        newline = np.concatenate([[0], np.cumsum(piece == 0x0A)])
        self.line = newline[self.starts]
        self.facts = self._facts()

    def _by_word(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.cuts[1:]] - sums[self.cuts[:-1]]

    def _repeated(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Share of keys of each text that stand earlier in it; keys are mixed with their text's number."""
        texts = len(self.cuts) - 1
        with np.errstate(over="ignore"):
            own = mixed(keys + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, at = np.unique(own, return_index=True)
        every = np.bincount(owner, minlength=texts)
        return 1 - np.bincount(owner[at], minlength=texts) / np.maximum(every, 1)

    def _facts(self) -> dict[str, np.ndarray]:
        """Counts and shares by text."""
        n = np.diff(self.cuts)
        count = len(self.hashes)
        owner = np.repeat(np.arange(len(n)), n)
        least = np.maximum(n, 1)
        begin = self.first | np.append(True, self.line[1:] != self.line[:-1])
        begins = np.flatnonzero(begin)
        within = np.arange(count) - np.repeat(begins, np.diff(np.append(begins, count)))
        with np.errstate(over="ignore"):
            line_keys = np.add.reduceat(mixed(self.hashes + within.astype(np.uint64)), begins)
        whole = np.flatnonzero(owner[4:] == owner[: count - 4]) if count > 4 else np.zeros(0, np.int64)
        five = shingles(self.hashes, 5)[whole] if len(whole) else np.zeros(0, np.uint64)
        chars = self._sums(self.chars)
        letters = self._sums(self.upper + self.lower + self.wide)
        insults, learnt = self._sums(self.insult), self._sums(self.learnt)
        return {
            "words": n,
            "signs": self._sums(self.signs) / least,
            "capitals": self._sums(self.upper) / np.maximum(letters, 1),
            "shouting": self._sums(self.marks) / least,
            "stutter": self._sums(self.same) / least,
            "same_lines": self._repeated(line_keys, owner[begins]),
            "letters": letters / np.maximum(chars, 1),
            "bare_signs": self._sums(self.signs == self.chars) / least,
            "same_passages": self._repeated(five, owner[whole]),
            "insults": insults,
            "insult_rate": insults / least,
            # no number where no word is known
            "learnt": learnt if self.taught else np.full(len(n), -1),
            "learnt_rate": learnt / least,
        }

    def text(self, k: int) -> dict:
        """The facts of text ``k``."""
        return {name: values[k] for name, values in self.facts.items()}


#: Votes by thresholds: junk from, clean up to; texts under the third number of words count as clean.
RULES = {
    "signs": (0.3, 0.05, 1),
    "capitals": (0.4, 0.15, 5),
    "shouting": (0.5, 0.05, 1),
    "stutter": (0.3, 0.05, 5),
    "same_lines": (0.4, 0.1, 5),
    "bare_signs": (0.25, 0.05, 5),
    "same_passages": (0.4, 0.2, 20),
}


def votes(facts: dict) -> list[int]:
    """One vote per labeller, in the order of ``LABELLERS``."""
    out = []
    for name in LABELLERS:
        value = facts[name]
        if name in RULES:
            junk, clean, least = RULES[name]
            out.append(CLEAN if facts["words"] < least or value <= clean else JUNK if value >= junk else ABSTAIN)
        elif name == "letters":
            out.append(CLEAN if facts["words"] < 20 or value > 0.75 else JUNK if value < 0.6 else ABSTAIN)
        elif name in ("insults", "learnt"):
            out.append(ABSTAIN if value < 0 else ABUSIVE if value >= 1 else CLEAN)
        else:
            out.append(ABUSIVE if value >= 0.005 else CLEAN)
    return out


def features(block: Blocks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of a text: shapes as shares, words hashed twice."""
    part = slice(block.cuts[k], block.cuts[k + 1])
    n = part.stop - part.start
    facts = block.text(k)
    shape = (
        (block.upper[part] > 0) * 1 + (block.lower[part] > 0) * 2 + (block.digits[part] > 0) * 4
        + (block.signs[part] > 0) * 8 + (block.marks[part] > 0) * 16 + block.same[part] * 32
    )
    seen = np.bincount(shape, minlength=64) / n
    extra = [facts[x] for x in ("same_lines", "same_passages", "capitals", "bare_signs", "stutter")]
    extra += [min(1.0, 20 * facts[x]) for x in ("insult_rate", "learnt_rate")]
    shapes = np.concatenate([seen, extra])
    used = np.flatnonzero(shapes)
    words, count = np.unique(block.bare[part], return_counts=True)
    value = np.sqrt(count / n)
    one = SHAPES + (words % np.uint64(BUCKETS)).astype(np.int64)
    two = SHAPES + ((words >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int64)
    sign_one = 1.0 - 2.0 * ((words >> np.uint64(60)) & np.uint64(1)).astype(float)
    sign_two = 1.0 - 2.0 * ((words >> np.uint64(61)) & np.uint64(1)).astype(float)
    return (
        np.concatenate([used, one, two]).astype(np.int32),
        np.concatenate([np.sqrt(shapes[used]), value * sign_one, value * sign_two]).astype(np.float32),
    )


def _each_text(texts: pa.Array, learnt: np.ndarray = NOTHING) -> Iterator[tuple[int, Blocks, int]]:
    """Row, block and place in it of every text with a word."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for row, hashes, cuts, starts, ends in hashed_words(texts):
        if len(hashes):
            block = Blocks(data, hashes, cuts, starts, ends, learnt)
            for k in range(len(cuts) - 1):
                if cuts[k + 1] > cuts[k]:
                    yield row + k, block, k


def vote_patterns(documents: DataFrame, learnt: Broadcast | None = None) -> DataFrame:
    """``doc_id`` and ``pattern``, the votes as a string of digits (null: no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = [None] * batch.num_rows
            for row, block, k in _each_text(batch.column("text"), learnt.value if learnt else NOTHING):
                found[row] = "".join(map(str, votes(block.text(k))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "pattern"])

    return _plain(documents).mapInArrow(run, "doc_id bigint, pattern string")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _one_each(plain: DataFrame, chosen: DataFrame) -> DataFrame:
    """The longest text of every chosen id (ties by hash); ``chosen`` has as many rows as a sample at most."""
    held = plain.join(F.broadcast(chosen), "doc_id")
    rank = F.struct(F.length("text"), F.xxhash64("text"))
    return held.groupBy(*chosen.columns).agg(F.max_by("text", rank).alias("text"))


def learn_abuse(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> np.ndarray:
    """Rising hashes of words that toxic documents use and others do not.

    What counts are a word's different neighbours, the fewer of those before and after it, so copies of a text bear witness once
    and near copies as often as an edit falls beside the word. A word is learnt if ``TOXIC_SHARE`` of its contexts are toxic ones
    and if, by Chernoff's bound shared among all words, so many of them would not come by chance. ``labels`` has ``doc_id`` and ``toxic`` (0 or 1).
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
        .limit(labelled)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for row, block, k in _each_text(batch.column("text")):
                words = block.bare[block.cuts[k] : block.cuts[k + 1]]
                around = np.pad(words, 1)
                found = np.unique(np.stack([words, around[:-2], around[2:]], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.ascontiguousarray(found[:, j])) for j in range(3)), pa.array(np.full(len(found), toxic[row], np.int32))],
                    ["word", "before", "after", "toxic"],
                )

    contexts = (
        _one_each(_plain(documents), chosen)
        .mapInArrow(run, "word bigint, before bigint, after bigint, toxic int")
        .groupBy("word", "before", "after")
        .agg(F.max("toxic").alias("toxic"))
    )
    # neighbours first, then words: a frequent word is counted in two steps
    sides = [
        contexts.groupBy("word", F.col(side).alias("beside")).agg(F.max("toxic").alias("toxic")).groupBy("word")
        .agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum("toxic").alias(f"bad_{side}"))
        for side in ("before", "after")
    ]
    counted = sides[0].join(sides[1], "word").select(
        "word",
        F.least("bad_before", "bad_after").alias("bad"),
        F.greatest(F.col("n_before") - F.col("bad_before"), F.col("n_after") - F.col("bad_after")).alias("good"),
    )
    counted = counted.select("word", "bad", (F.col("bad") + F.col("good")).alias("n"))
    counted = Stored(documents.sparkSession, "abuse").table(counted, "words")
    total = counted.agg(F.sum("n"), F.sum("bad"), F.count(F.lit(1))).first()
    if not total[1] or total[1] == total[0]:
        return NOTHING
    usual, limit = total[1] / total[0], float(np.log(total[2] / CHANCE))
    share = F.col("bad") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    found = counted.where((share >= max(TOXIC_SHARE, usual)) & (F.col("n") * (share * F.log(share / usual) + rest) >= limit))
    # at most the words of the sample
    return np.sort(np.array([r["word"] for r in found.select("word").collect()], np.int64).view(np.uint64))


def fit_labels(patterns: list[str], counts: list[int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of Dawid and Skene: posterior by pattern, class shares, vote rates.

    ``rates[l, c, v]`` is how often labeller ``l``, votes ``v`` (3: abstains) in class ``c``. The start is
    the vote itself: abusive if any labeller says so, else junk if any does. Junk and abuse that no labeller votes for are not
    believed, so the classes keep their meaning however few votes one has. Labellers of abuse are trusted in advance not to warn
    of clean documents, as if they had passed ``TRUST`` of all: a lone one would else be neither believed nor doubted.
    """
    seen = np.array([[int(v) for v in p] for p in patterns])
    weight = np.array(counts, float)
    start = np.where((seen == ABUSIVE).any(axis=1), ABUSIVE, np.where((seen == JUNK).any(axis=1), JUNK, CLEAN))
    possible = np.stack([(seen == c).any(axis=1) | (c == CLEAN) for c in range(3)], axis=1)
    posterior = np.full((len(seen), 3), 0.05)
    posterior[np.arange(len(seen)), start] = 0.9
    warned = (seen == ABUSIVE).any(axis=0)
    posterior *= possible
    posterior /= posterior.sum(axis=1, keepdims=True)
    shares = rates = None
    for _ in range(rounds):
        mass = posterior * weight[:, None]
        shares = (mass.sum(axis=0) + 1) / (weight.sum() + 3)
        rates = np.stack(
            [
                np.stack([np.bincount(seen[:, j], mass[:, c], 4) + 0.5 for c in range(3)])
                for j in range(seen.shape[1])
            ]
        )
        rates[warned, CLEAN, CLEAN] += TRUST * weight.sum()
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.log(shares) + sum(np.log(rates[j][:, seen[:, j]]).T for j in range(seen.shape[1]))
        logs[~possible] = -np.inf
        logs -= logs.max(axis=1, keepdims=True)
        fresh = np.exp(logs)
        fresh /= fresh.sum(axis=1, keepdims=True)
        if np.abs(fresh - posterior).max() < 1e-6:
            posterior = fresh
            break
        posterior = fresh
    return posterior, shares, rates


def fit_scorer(
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], passes: int = 4, rate: float = 0.3, sparse: float = 0.5
) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft labels by FTRL-proximal; weights and intercepts.

    Rows are taken in the given order, so the same sample gives the same scorer.
    """
    size = SHAPES + BUCKETS
    z, squares = np.zeros((size, 3)), np.zeros((size, 3))
    bias = np.zeros(3)

    def weights(at: np.ndarray) -> np.ndarray:
        held = z[at]
        return -np.sign(held) * np.maximum(np.abs(held) - sparse, 0) / ((1 + np.sqrt(squares[at])) / rate)

    for _ in range(passes):
        for at, value, target in rows:
            w = weights(at)
            score = bias + value @ w
            score = np.exp(score - score.max())
            wrong = score / score.sum() - target
            step = value[:, None] * wrong
            more = squares[at] + step**2
            z[at] += step - (np.sqrt(more) - np.sqrt(squares[at])) / rate * w
            squares[at] = more
            bias -= 0.02 * wrong
    return weights(np.arange(size)), bias


def classify(documents: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, p_clean, p_junk, p_abusive, weak_clean, kept`` for every document.

    ``weak_clean`` is the label model's own posterior; ``kept`` says that clean is the
    scorer's likeliest class. ``labels`` (``doc_id``, ``toxic``) teaches words of abuse.
    """
    return _scored(documents, ["doc_id"], sample, labels).select(F.col("row.doc_id").cast("long").alias("doc_id"), "verdict.*")


def keep_clean(documents: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """The rows, with all columns, whose likeliest class is clean."""
    return _scored(documents, documents.columns, sample, labels).where("verdict.kept").select("row.*")


def _scored(documents: DataFrame, columns: list[str], sample: int, labels: DataFrame | None) -> DataFrame:
    """``row``, the given columns, and ``verdict`` of every document."""
    spark = documents.sparkSession
    stored = Stored(spark, "quality")
    words = learn_abuse(documents, labels) if labels is not None else NOTHING
    learnt = spark.sparkContext.broadcast(words)
    patterns = stored.table(vote_patterns(documents, learnt).select("pattern"), "patterns")
    # at most 4 ** 11 rows, whatever the number of documents
    counted = patterns.where("pattern is not null").groupBy("pattern").count().orderBy("pattern").collect()
    if counted:
        posterior, _, _ = fit_labels([r["pattern"] for r in counted], [r["count"] for r in counted])
        by_pattern = {r["pattern"]: posterior[k] for k, r in enumerate(counted)}
        weights, bias = fit_scorer(_training_rows(documents, by_pattern, sample, learnt))
    else:
        by_pattern, weights, bias = {}, np.zeros((SHAPES + BUCKETS, 3)), np.zeros(3)
    model = spark.sparkContext.broadcast((weights.astype(np.float32), bias, by_pattern))  # 3 MB at any size of the input
    rows = documents.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    fields = extended(
        rows.select("row").schema,
        "verdict struct<p_clean:double,p_junk:double,p_abusive:double,weak_clean:double,kept:boolean>",
    )
    names = ["p_clean", "p_junk", "p_abusive", "weak_clean", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, weak = model.value
        for batch in batches:
            scores = np.tile(b, (batch.num_rows, 1))
            belief: list[float | None] = [None] * batch.num_rows
            for row, block, k in _each_text(batch.column("text"), learnt.value):
                at, value = features(block, k)
                scores[row] = b + value.astype(float) @ w[at]
                belief[row] = float(weak["".join(map(str, votes(block.text(k))))][CLEAN])
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            scores /= scores.sum(axis=1, keepdims=True)
            verdict = pa.StructArray.from_arrays(
                [
                    *(pa.array(scores[:, c]) for c in range(3)), pa.array(belief, pa.float64()),
                    pa.array(scores[:, CLEAN] >= scores[:, 1:].max(axis=1)),
                ],
                names,
            )
            yield pa.RecordBatch.from_arrays([batch.column("row"), verdict], ["row", "verdict"])

    return rows.mapInArrow(run, fields)


def _training_rows(documents: DataFrame, by_pattern: dict, sample: int, learnt: Broadcast) -> list:
    """Features and posteriors of one row of each of the ``sample`` ids of least hash."""
    plain = _plain(documents)
    order = F.xxhash64("doc_id", F.lit(4))
    chosen = plain.where("doc_id is not null").select(order.alias("h"), "doc_id").distinct().orderBy("h", "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, k in _each_text(batch.column("text"), learnt.value):
                at, value = features(block, k)
                pattern = "".join(map(str, votes(block.text(k))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, 1), pa.array([pattern]),
                        pa.array([at.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary()),
                    ],
                    ["doc_id", "pattern", "at", "value"],
                )

    held = (
        _one_each(plain, chosen.select("doc_id"))
        .mapInArrow(run, "doc_id bigint, pattern string, at binary, value binary")
        .collect()
    )
    held.sort(key=lambda r: (hash((r["doc_id"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFF), r["doc_id"], bytes(r["at"])))
    return [
        (np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32).astype(float), by_pattern[r["pattern"]])
        for r in held
    ]
