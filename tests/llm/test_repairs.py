"""Spelling variants, repeated strings and conversation repair against brute force."""

import itertools
import random

import numpy as np
import pytest

import brute
from conftest_rows import prose, rows
from oracle_check import DATA
from placewright.llm import conversations, spelling, suffix_dedup
from placewright.llm.common import Stored


def spelled(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}


def test_spelling_equals_brute_force(spark):
    draw = random.Random(3)
    letters = "abeÉé"
    words = ["".join(draw.choice(letters) for _ in range(draw.choice([4, 5, 5, 6]))) for _ in range(400)]
    texts = [(k, " ".join(draw.choices(words, range(len(words), 0, -1), k=200))) for k in range(60)]
    texts += [(None, "Straße ÷× Straße's STRAßE"), (3, None), (4, "")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n").repartition(5)
    want = brute.spelling(texts)
    assert len(want) > 100 and sum(v[3] for v in want.values()) > 100
    assert spelled(frame) == want


def test_spelling_of_odd_rows(spark, odd, none):
    got = spelled(odd)
    want = brute.spelling([(r[0], r[1]) for r in rows()])
    assert got == want
    assert spelled(none) == {}


def test_long_words_are_paired_by_hash(spark):
    draw = random.Random(8)
    words = set()
    for _ in range(6):
        base = "".join(draw.choice("abc") for _ in range(draw.randint(45, 52)))
        words.add(base)
        for _ in range(6):
            at = draw.randrange(len(base))
            words |= {base[:at] + base[at + 1 :], base[:at] + draw.choice("abcxyz") + base[at + 1 :], base[:at] + "q" + base[at:]}
    words.add("z" * 30_000)
    words.add("z" * 29_999)
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_words(frame, Stored(spark, "test")).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        at = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
        return a[at + 1 :] == b[at + (len(a) == len(b)) :]

    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}


def removed(frame):
    return [tuple(r) for r in suffix_dedup.remove_repeats(frame).collect()]


def texts_with_passages():
    draw = random.Random(5)
    passage, other = prose(50, 40), prose(51, 14)
    out = [(k, prose(k, 30)) for k in range(20)]
    out += [(20 + k, prose(200 + k, 8) + passage[draw.randint(0, 60) : draw.randint(120, 260)] + prose(300 + k, 9)) for k in range(40)]
    out += [(70 + k, other * draw.randint(1, 3)) for k in range(6)]
    out += [(80, "ab" * 300), (81, "a" * 150), (82, "a" * 99), (83, "a" * 100), (84, "é" * 120), (85, "\0" * 130), (86, None), (87, "")]
    out += [(90, passage), (91, passage), (-5, passage[40:190])]
    return out


@pytest.mark.parametrize("wide, slice_bytes, block", [(4096, 1 << 20, 2 << 20), (7, 230, 900)])
def test_repeats_equal_brute_force(spark, monkeypatch, wide, slice_bytes, block):
    """The second case deals keys over tasks, cuts texts and blocks: whole results all the same."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = texts_with_passages()
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS key").repartition(4)
    want = brute.repeats(texts)
    assert sum(r[2] for r in want) > 3000
    assert sorted(removed(frame)) == want


def test_repeats_of_odd_rows(spark, odd, none):
    got = removed(odd)
    assert len(got) == len(rows()) and removed(none) == []
    by_id = {}
    for row in got:
        by_id.setdefault(row[0], set()).add(row[1:])
    raw = len(rows()[1][1].encode())
    assert {(n, gone, spans) for n, gone, spans, _ in by_id[2]} == {(raw, raw, 1)}
    # repeated rows have the same starts, so neither is the earlier one
    assert len(by_id[4]) == 1 and next(iter(by_id[4]))[1] == 0
    # a run of one letter keeps its first string
    assert next(iter(by_id[11]))[:3] == (3_000_000, 3_000_000 - 1, 1)


def test_suffix_order_is_the_order_of_suffixes():
    draw = np.random.default_rng(2)
    pieces = [draw.integers(1, 4, draw.integers(1, 60)).astype(np.uint8) for _ in range(60)]
    pieces += [pieces[3], pieces[4][5:], np.full(50, 2, np.uint8)]
    symbols = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.uint8)
    left = np.concatenate([np.arange(len(p), -1, -1) for p in pieces])
    order = suffix_dedup.suffix_order(symbols, left)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    suffixes = [symbols[k : k + left[k]].tobytes() for k in order.tolist()]
    assert suffixes == sorted(suffixes)


RESULT = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def mended(frame):
    return {r["conv_id"]: tuple(r[c] for c in RESULT[1:]) for r in conversations.damage_and_repair(frame).collect()}


def talk():
    draw = random.Random(9)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None]
    texts = ["Fine.", "Well", "No?", " \n", "", "Yes!\x0b ", "Odd.\x85", None]
    out = [(c, t, draw.choice(roles), draw.choice(texts)) for c in range(120) for t in range(draw.randint(1, 9))]
    out += [(None, t, "user", "Hm.") for t in range(4)]
    out += [(500, draw.choice([None, 1, 2, 3, -4]), draw.choice(roles), draw.choice(texts)) for _ in range(40)]
    out += [(501, t, "user" if t % 3 else "assistant", f"Line {t % 40}.") for t in range(700)]
    return out


def test_conversations_equal_brute_force(spark, none):
    given = talk()
    frame = spark.createDataFrame(given, "conv_id bigint, turn int, role string, text string")
    frame = frame.selectExpr("*", "1 AS phase", "'x' AS audit").repartition(6)
    assert mended(frame) == brute.conversations(given)
    assert mended(frame.limit(0)) == {}


def test_given_conversations_equal_brute_force(spark):
    frame = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    given = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert mended(frame) == brute.conversations(given)


def test_least_cost_of_every_short_row():
    """Every sequence of up to five symbols: cost and audit equal the plain search."""
    rows_of = {0: ("user", ""), 1: ("system", "a."), 2: ("user", "a."), 3: ("assistant", "a."), 4: ("x", "a."),
               5: ("system", "a"), 6: ("user", "a"), 7: ("assistant", "a"), 8: ("x", "a")}
    for length in range(1, 5):
        for symbols in itertools.product(range(9), repeat=length):
            edits = conversations.Edits(bytes(symbols))
            got = edits.cost, "".join(letters for letters, _ in edits.rows())
            # texts made different, so that only symbol 0 has to go
            given = [(k, role, text and f"{k}{text}") for k, (role, text) in enumerate(rows_of[s] for s in symbols)]
            assert got == brute.repaired(given)[5:7], symbols
