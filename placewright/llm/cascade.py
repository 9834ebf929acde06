"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A document is kept if it passes the base rule and every rule of ``RULES``. The outcome
does not depend on the order, the cost does: on a sample, each rule is timed and its rejections
counted, and the rules then run by falling rejections per nanosecond, each only on the documents
that all rules before it let through.

Words are runs of anything but blank, tab and line separators. The sample (about ``SAMPLE`` rows, drawn at random) decides nothing but
the order. A null text has no words and fails the base rule; repeated rows get the same verdict each;
an empty table gives no rows and the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import hashed_words, shingles

SAMPLE = 2_000
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words
WINDOW = 5
# The signs that n_symbols counts.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


class Block:
    """A few texts as arrays, and what the rules have in common."""

    def __init__(self, data: np.ndarray, hashes: np.ndarray, cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.hashes, self.cuts = hashes, cuts
        self.n_words = np.diff(cuts)
        low, high = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
        self.piece, self.starts, self.ends = data[low:high], starts - low, ends - low
        self.owner = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def by_text(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text's words; counted bytes never lie between words."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        word = sums[self.ends] - sums[self.starts]
        total = np.concatenate([[0], np.cumsum(word)])
        return total[self.cuts[1:]] - total[self.cuts[:-1]]

    @lru_cache(2)
    def letters(self, first: int) -> np.ndarray:
        """By word, how many of the 26 letters that start at byte ``first``."""
        sums = np.concatenate([[0], np.cumsum((self.piece >= first) & (self.piece < first + 26), dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]

    def word_chars(self) -> np.ndarray:
        return self.by_text((self.piece & 0xC0) != 0x80)

    def n_symbols(self) -> np.ndarray:
        return self.by_text(_SYMBOL[self.piece])


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside five-word windows that occur at least twice in the text."""
    n = len(hashes)
    if n <= WINDOW:
        return 0
    windows = shingles(hashes, WINDOW)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return count


#: Rules of the cascade: a document fails if the rule says so. All look at counts that a row carries.
Rule = Callable[[dict], bool]
RULES: dict[str, Rule] = {
    # mean word length outside 2 to 25 code points
    "word_length": lambda d: not 2 * d["n_words"] <= d["word_chars"] <= 25 * d["n_words"],
    # more than one sign in five words
    "symbols": lambda d: 5 * d["n_symbols"] > d["n_words"],
    # more than 40 percent of the lines with a word repeat an earlier one
    "lines": lambda d: 10 * d["n_dup_lines"] > 4 * d["n_lines"],
    # more than 40 percent of the words with A-Z and no a-z, of texts of 20 words or more
    "capitals": lambda d: d["n_words"] >= 20 and 10 * d["n_capital_words"]() > 4 * d["n_words"],
    # more than 30 percent of the words equal the word before
    "stutter": lambda d: 10 * d["n_stutters"]() > 3 * d["n_words"],
}


def _rows(texts: pa.Array) -> Iterator[tuple[int, dict]]:
    """Row number and facts of every text; facts of costly rules are calls."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = memoryview(texts.buffers()[2] or b"")
    for row, hashes, cuts, starts, ends in hashed_words(texts):
        block = Block(data, hashes, cuts, starts, ends)
        chars, symbols = block.word_chars(), block.n_symbols()
        for k, n in enumerate(block.n_words.tolist()):
            own = hashes[cuts[k] : cuts[k + 1]]
            text = bytes(whole[offsets[row + k] : offsets[row + k + 1]])

            def capitals(block=block, own=slice(cuts[k], cuts[k + 1])) -> int:
                return int(((block.letters(0x41)[own] > 0) & (block.letters(0x61)[own] == 0)).sum())

            def stutters(own=own) -> int:
                return int((own[1:] == own[:-1]).sum())

            yield row + k, {
                "n_words": n,
                "word_chars": int(chars[k]),
                "n_symbols": int(symbols[k]),
                "n_dup_lines": duplicate_lines(text),
                "n_lines": sum(1 for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")),
                "n_repeat_words": repeated_words(own),
                "n_capital_words": capitals,
                "n_stutters": stutters,
            }


def rule_costs(documents: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Nanoseconds a document and share rejected, by rule, on a random sample."""
    plain = documents.select(F.col("text").cast("string").alias("text"))
    rows = plain.count()
    if not rows:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, seen = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for _, facts in _rows(batch.column("text")):
                seen += 1
                for name, rule in RULES.items():
                    begin = time.perf_counter_ns()
                    failed[name] += rule(facts)
                    spent[name] += time.perf_counter_ns() - begin
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(RULES)), pa.array(spent.values(), pa.int64()), pa.array(failed.values(), pa.int64()), pa.array([seen] * len(RULES), pa.int64())],
            ["rule", "spent", "failed", "seen"],
        )

    drawn = plain.sample(min(1.0, sample / rows), seed=8)
    measured = (
        drawn.mapInArrow(run, "rule string, spent bigint, failed bigint, seen bigint")
        .groupBy("rule")
        .agg(F.sum("spent").alias("spent"), F.sum("failed").alias("failed"), F.sum("seen").alias("seen"))
        .collect()  # a row per rule
    )
    return {r["rule"]: (r["spent"] / r["seen"], r["failed"] / r["seen"]) for r in measured if r["seen"]}


def order_of(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by falling rejections per cost; rules that were not measured keep their place at the end."""
    known = sorted(costs, key=lambda name: (-(costs[name][1] / max(costs[name][0], 1e-9)), costs[name][0], name))
    return known + [name for name in RULES if name not in costs]


FIELDS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, failed_rule string"
)


def apply_rules(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Counts, base verdict, verdict and the rule that stopped the cascade, per document.

    ``order`` is taken from :func:`rule_costs` if not given.
    """
    order = order_of(rule_costs(documents)) if order is None else order
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in [*counts, "base_failed", "kept", "failed_rule"]}
            for _, facts in _rows(batch.column("text")):
                for name in counts:
                    out[name].append(facts[name])
                base = facts["n_words"] < LEAST_WORDS or 100 * facts["n_repeat_words"] > MOST_REPEATED * facts["n_words"]
                stopped = "base" if base else next((name for name in order if RULES[name](facts)), None)
                out["base_failed"].append(base)
                out["kept"].append(stopped is None)
                out["failed_rule"].append(stopped)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in counts),
                    pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_()), pa.array(out["failed_rule"], pa.string()),
                ],
                ["doc_id", *counts, "base_failed", "kept", "failed_rule"],
            )

    return plain.mapInArrow(run, FIELDS)
