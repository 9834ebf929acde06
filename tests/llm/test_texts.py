"""Operators on single texts: against brute force, round trips and the odd cases."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from placewright.llm import bpe, cascade, main_text, mixing, ngram, quality, queries, secret_scan
from placewright.llm.common import hashed_words, labelled, runs, shingles
from conftest_rows import prose, rows

RAW = queries.rank_file()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
#: Words of abuse in the test tables.
ABUSE = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_cut_and_hashed_alike():
    texts = ["", None, "a b", "\x85 A\xa0b é\tc", prose(3), "w" * 3_000_000 + " z", " " * 2_500_000]
    found = {}
    for row, hashes, cuts, _, _ in hashed_words(pa.array(texts), fold=True):
        for k in range(len(cuts) - 1):
            found[row + k] = hashes[cuts[k] : cuts[k + 1]].tolist()
    by_word: dict[str, int] = {}
    for k, text in enumerate(texts):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        assert len(words) == len(found[k])
        for word, value in zip(words, found[k]):
            assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_hashing_holds_little_beside_its_texts():
    texts = pa.array(["word " * 400 + str(n) for n in range(2_000)])
    tracemalloc.start()
    rows_seen = sum(len(cuts) - 1 for _, _, cuts, _, _ in hashed_words(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows_seen == 2_000
    assert peak < 30e6  # 4 MB of texts


def test_labels_make_repeats_distinct():
    values = shingles(np.array([1, 2, 1, 2, 1, 2], np.uint64), 2)
    assert len(set(values.tolist())) == 2 and len(set(labelled(values).tolist())) == 5


def test_runs_ignore_batch_borders():
    keys = [1, 1, 2, 2, 2, 3]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b]}) for a, b in ((0, 1), (1, 4), (4, 4), (4, 6))]
    assert [t.column("k").to_pylist() for t in runs(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [3]]


def test_tokens_equal_the_library():
    draw = random.Random(2)
    parts = ["'s", "'re", " ", "  ", "\n", "\xa0", "a", "the", "é", "中文", "12", "½", "!", "''", "aaaa", "\U0001f600", "'S", "\x1c", "Ᲊ"]
    texts = ["", "'", "a" * 4_000, " " * 999, "ab" * 2_000] + ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(3_000)]
    coder = bpe.Encoder(bpe.Merges(RAW))
    for text, ids in zip(texts, coder.block(texts)):
        assert ids.tolist() == LIBRARY.encode_ordinary(text), text[:50]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choices(["ab", " ", "  ", "\n", " \n", "é", "1", "'s", "!"], k=4_000))
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50)
    assert len(list(bpe._parts(text))) > 20 and "".join(bpe._parts(text)) == text
    got = bpe.Encoder(bpe.Merges(RAW)).block([text, "", "a b"])
    assert [ids.tolist() for ids in got] == [LIBRARY.encode_ordinary(t) for t in (text, "", "a b")]


def test_round_trip_of_odd_rows(odd, none):
    got = bpe.round_trip(odd, RAW, ["doc_id", "kept"], with_ids=True).collect()
    texts = collections.Counter((r[0], r[1] or "") for r in rows())
    assert len(got) == len(rows())
    digests = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in got)
    assert digests == collections.Counter({(k, hashlib.sha256(t.encode()).hexdigest()): n for (k, t), n in texts.items()})
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
    assert bpe.round_trip(none, RAW, ["doc_id"]).count() == 0
    coded = bpe.encode(odd, RAW, ["doc_id"])
    assert {bytes(r["decoded"]).decode() for r in bpe.decode(coded, RAW, ["doc_id"]).collect()} == {t for _, t in texts}


def test_base_secrets_equal_plain_expressions(odd, none):
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
    )
    draw = random.Random(7)
    parts = ["token", "API_KEY", "secret", "pass", "wd", "password", ":", "=", " ", '"', "abc", "0f3a9c", "AKIA", "Q7Z", "ſ", "é", "deadbeef" * 3, "A1B2" * 4]
    for _ in range(3_000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 30)))
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s for s in secret_scan.spans(text) if s[1] < 3] == sorted(base)
    report = {r["doc_id"]: r for r in secret_scan.secret_report(odd).collect()}
    assert report[12]["n_assign"] == 1 and report[5]["spans"] == "" and secret_scan.secret_report(odd).count() == len(rows())
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.redact(odd).collect()}
    assert "hunter2" not in hidden[12] and hidden[12].startswith("key [secret]") and hidden[4] == prose(4) and hidden[5] is None
    assert secret_scan.secret_report(none).count() == 0


def test_battery_tells_random_tokens_from_words():
    draw = random.Random(3)
    alphabet = secret_scan.ALPHABETS["random_base64"][0]
    tokens = ["".join(draw.choices(alphabet, k=40)) for _ in range(300)]
    found = sum(bool(secret_scan.spans(f"see {t} now")) for t in tokens)
    assert found >= 270
    plain = ["Thisisaratherlongnameofaclass2000", "section/contents/2024/page/12", "A1A1A1A1A1A1A1A1A1A1a1a1a1a1a1", "internationalisation"]
    assert not [p for p in plain if secret_scan.spans(p)]


def test_weighted_false_discovery():
    assert secret_scan.not_random([], []) == []
    assert secret_scan.not_random([1e-9, 0.9, 0.5], [20, 20, 20]) == [True, False, False]
    # the same p-value counts for more in a longer token
    assert secret_scan.not_random([0.02, 0.9], [60, 20]) == [True, False]
    assert secret_scan.not_random([0.03, 0.9], [20, 60]) == [False, False]


def test_rule_counts_and_verdicts(odd, none):
    got = cascade.apply_rules(odd).collect()
    assert len(got) == len(rows()) and cascade.apply_rules(none).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows():
        if doc_id is not None:
            words = WORD.findall(text or "")
            seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
            r = by_id[doc_id]
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
    assert by_id[4]["kept"] and not by_id[8]["kept"] and by_id[8]["base_failed"]


def test_order_does_not_change_verdicts(odd):
    one = cascade.apply_rules(odd, list(cascade.RULES)).select("doc_id", "kept").collect()
    two = cascade.apply_rules(odd, list(cascade.RULES)[::-1]).select("doc_id", "kept").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
    assert cascade.order_of({"lines": (10.0, 0.5), "symbols": (1.0, 0.2), "stutter": (1.0, 0.0)})[:3] == ["symbols", "lines", "stutter"]


def test_scores_equal_brute_force(odd, none, monkeypatch):
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows()}
    counts = collections.Counter(w for r in rows() if not held[r[0]] for w in fold(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    for frequent in (1_000_000, 20):
        monkeypatch.setattr(ngram, "FREQUENT", frequent)
        got = {r["doc_id"]: r for r in ngram.score_documents(odd).collect()}
        for doc_id, text, *_ in rows():
            if doc_id is not None:
                base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in fold(text))
                r = got[doc_id]
                assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["train_tokens"] == total
                assert r["n_tokens"] == len(fold(text)) and r["n_known"] == sum(counts[w] > 0 for w in fold(text))
                assert r["held_out"] == held[doc_id] and r["score"] <= 0
    assert ngram.score_documents(none).count() == 0


def test_scores_equal_a_model_of_quantised_counts(odd, monkeypatch):
    monkeypatch.setattr(ngram, "BITS_AN_ENTRY", 400)  # so that no level is found by chance
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows()}
    trained = [fold(r[1]) for r in rows() if not held[r[0]]]
    ones = collections.Counter(w for words in trained for w in words)
    twos = collections.Counter(pair for words in trained for pair in zip([None, *words], words))
    lower = lambda n: 2.0 ** (n.bit_length() - 1) if n else 0.0
    room = sum(ones.values()) + len(ones) + 1
    assert sum(n == 1 for n in twos.values()) > 1_000
    for frequent in (1_000_000, 20):
        monkeypatch.setattr(ngram, "FREQUENT", frequent)
        got = {r["doc_id"]: r["score"] for r in ngram.score_documents(odd).collect()}
        for doc_id, text, *_ in rows():
            if doc_id is not None:
                want, before = 0.0, None
                for word in fold(text):
                    pair = lower(twos[before, word])
                    chance = (pair + ngram.SMOOTHING * (ones[word] + 1) / room) / (ones[before] + ngram.SMOOTHING)
                    want, before = want + math.log10(chance), word
                    assert chance <= 1
                assert abs(got[doc_id] - want) < 1e-6 * max(1, abs(want)), doc_id


def test_several_broadcasts_give_the_scores_of_one(odd, monkeypatch):
    monkeypatch.setattr(ngram, "SEGMENT_ROWS", 5_000)
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows_by = lambda: sorted((str(r["doc_id"]), *(round(r[c], 6) for c in columns)) for r in ngram.score_documents(odd).collect())
    want = rows_by()
    monkeypatch.setattr(ngram, "FILTER_BYTES", 1 << 14)
    assert rows_by() == want and len(want) == len(rows())


def test_probing_stops_at_the_greatest_level():
    h = np.random.default_rng(2).integers(0, 1 << 63, 100, dtype=np.uint64)
    assert (ngram.CountFilter({0: b"\xff" * 64}, 1, 5).levels(h) == 5).all()


def test_filter_returns_levels():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5_000, dtype=np.uint64)
    q = np.arange(5_000) % 6
    seg = h.view(np.int64) % 3
    order = np.argsort(seg, kind="stable")
    part = pa.RecordBatch.from_pydict({"seg": seg[order], "h": h.view(np.int64)[order], "q": q[order].astype(np.int32)})
    held = {r["seg"]: r["bits"] for b in ngram._segments(12.0)(iter([part])) for r in b.to_pylist()}
    found = ngram.CountFilter(held, 3).levels(h)
    # a Bloom filter never loses a member
    assert (found >= q).all() and (found == q).mean() > 0.9
    assert not ngram.CountFilter({}, 1).levels(h).any()


def test_classifier_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = quality.classify(documents, labels=labels)
    seen = got.join(labels, "doc_id").collect()
    clean = [r for r in seen if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r for r in seen if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    # a fifth of the documents labelled toxic has no word of abuse, so nothing tells them from clean ones
    toxic = [r for r in seen if r["toxic"] == 1]
    insulting = {r["doc_id"] for r in documents.where(F.col("text").rlike(f"(?i)\\b({'|'.join(ABUSE)})\\b")).collect()}
    plain = [r for r in toxic if r["doc_id"] in insulting]
    assert len(plain) >= 0.6 * len(toxic) and not any(r["kept"] for r in plain)
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_abuse_outside_the_list_is_learnt(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    # half of the labels teach, the others judge; the listed words are replaced by words that no list holds
    taught = labels.where("doc_id % 2 = 0")
    strange = F.col("text")
    for k, word in enumerate(ABUSE):
        strange = F.regexp_replace(strange, f"(?i){word}", f"zorb{'klmnprstvx'[k]}ak")
    changed = documents.select("doc_id", strange.alias("text"))
    seen = quality.classify(changed, labels=taught).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r for r in seen if r["quality"] == 1 and r["toxic"] == 0]
    insulting = {r["doc_id"] for r in changed.where("text rlike 'zorb[a-z]ak'").select("doc_id").collect()}
    toxic = [r for r in seen if r["toxic"] == 1 and r["doc_id"] in insulting]
    assert len(toxic) > 100 and sum(not r["kept"] for r in toxic) >= 0.95 * len(toxic)
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_copies_of_one_text_teach_nothing(spark):
    prose_rows = [(k, prose(900 + k, 60)) for k in range(300)]
    copies = [(1_000 + k, f"{prose(1, 20)} blorp {prose(2, 20)}") for k in range(100)]
    abuse = [(2_000 + k, f"{prose(5_000 + k, 20)} snark! {prose(7_000 + k, 20)}") for k in range(40)]
    documents = spark.createDataFrame(prose_rows + copies + abuse, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(k, 0, 9) for k, _ in prose_rows] + [(k, 1, 9) for k, _ in copies + abuse] + [(None, 1, 9), (1, None, 9), (77_777, 1, 9)],
        "doc_id bigint, toxic int, text int",
    )
    known = {word: quality._among(next(quality._each_text(pa.array([word])))[1].bare, quality.learn_abuse(documents, labels))[0] for word in ("snark", "blorp")}
    assert known == {"snark": True, "blorp": False}
    assert not len(quality.learn_abuse(documents, labels.limit(0))) and not len(quality.learn_abuse(documents.limit(0), labels))


def test_classifier_on_odd_rows(odd, none):
    got = quality.classify(odd).collect()
    assert len(got) == len(rows()) and all(abs(r["p_clean"] + r["p_junk"] + r["p_abusive"] - 1) < 1e-6 for r in got)
    assert quality.keep_clean(odd).columns == odd.columns and quality.classify(none).count() == 0


def test_label_model_follows_agreeing_labellers():
    # the third labeller is often wrong; the first two go together
    patterns = ["000", "001", "110", "111"]
    posterior, shares, rates = quality.fit_labels(patterns, [800, 60, 60, 80])
    assert posterior[0].argmax() == quality.CLEAN and posterior[2].argmax() != quality.CLEAN and posterior[3].argmax() != quality.CLEAN
    assert shares.argmax() == quality.CLEAN and np.allclose(rates.sum(axis=2), 1)


@pytest.mark.parametrize("seed", range(20))
def test_every_prefix_of_the_frame_is_within_a_block(seed):
    draw = random.Random(seed)
    units = mixing.whole_units({f"s{k}": draw.random() ** 3 + 1e-3 for k in range(draw.randint(1, 15))}, 1_000)
    frame = mixing.frame_of(units)
    owner = {slot: name for name, slots in frame.items() for slot in slots}
    assert len(owner) == sum(units.values()) == 1_000
    seen = dict.fromkeys(units, 0)
    for slot in range(1_000):
        seen[owner[slot]] += 1
        assert all(abs(seen[n] - units[n] * (slot + 1) / 1_000) < 1 for n in units)


def test_mix_places_every_document(odd, none):
    got = mixing.mix(odd, block_chars=100).collect()
    assert len(got) == len(rows()) and mixing.mix(none).count() == 0
    places = collections.defaultdict(list)
    for r in got:
        places[r["source"]].append((r["place"], r["block"], r["slot"]))
    for held in places.values():
        held.sort()
        assert [b for _, b, _ in held] == sorted(b for _, b, _ in held) and [s for *_, s in held] == sorted(s for *_, s in held)
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 1.0})


@pytest.mark.parametrize(
    ("weights", "units"),
    [({"a": 0.6, "b": 0.3994, "c": 0.0006}, (3000, 1997, 3)), ({"a": 1, "b": Fraction(1, 3), "c": Fraction(1, 6)}, (6, 2, 1))],
)
def test_mix_equals_a_schedule_made_slot_by_slot(spark, weights, units):
    docs = [(k, "abc"[k % 3], "x" * (7 * k % 23)) for k in range(3_000)] + [(5, "c", "y" * 7)] * 4
    got = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), weights, block_chars=10).collect()
    share = {name: Fraction(u, sum(units)) for name, u in zip("abc", units)}
    assert mixing.exact_units(weights) == dict(zip("abc", units))
    done, slot_of = dict.fromkeys("abc", 0), {}
    last = max(r["slot"] for r in got if r["source"] == "a")
    for slot in range(last + 1):
        # released blocks, the earliest deadline first
        name = min((-(-(done[n] + 1) // share[n]), n) for n in "abc" if done[n] // share[n] <= slot)[1]
        slot_of[name, done[name]] = slot
        done[name] += 1
        assert all(abs(done[n] - share[n] * (slot + 1)) < 1 for n in "abc")
    seen = [r for r in got if (r["source"], r["block"]) in slot_of]
    assert len(seen) > 1_000 and all(r["slot"] == slot_of[r["source"], r["block"]] for r in seen)
    assert len(got) == len(docs)


def test_weights_that_cannot_be_met(spark):
    with pytest.raises(ValueError):
        mixing.exact_units({"a": 1.0, "b": 0.0})
    fine = mixing.exact_units({"a": 0.1234567891, "b": 0.7654321})
    assert sum(fine.values()) == mixing.MOST_SLOTS


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href=1>One</a></li></ul></nav>
<div id="content"><h1>Head &amp; line</h1><p>A first paragraph that is long enough to stand out among the lines of the page.</p><p>Short.
<form>Mail <input></form><p>A second&nbsp;one, <b>also</b> long<i>er</i> than what is around it &lt;here&gt; and there.
<div class="comments"><p>I liked this very much, and I write it at length so that it looks like text.</p></div></div>
<aside>More</aside><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text.main_text(PAGE) == (
        "Head & line A first paragraph that is long enough to stand out among the lines of the page. Short. "
        "A second one, also longer than what is around it <here> and there."
    )
    assert main_text.main_text("") == main_text.main_text("<nav>x</nav>") == ""
    assert main_text.main_text("<nav>x<article><p>never closed</article>") == "never closed"
    assert main_text.main_text("<![odd[x]]><p>a &notit; <!-- c --> b") == "a ¬it; b"


LONG = "One sentence of the story that is long enough to count as running text, as articles have it."
MORE = "Another paragraph goes on about the same matter at some length, so that nobody takes it for a menu."
NAV = "<ul class='menu'><li><a href=a>Home</a><li><a href=b>News</a></ul>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # a head that was never closed
        (f"<html><head><title>t</title><meta x><body>{NAV}<p>{LONG}</p></body>", LONG),
        (f"<head><style>p {{}}</style><p>{LONG}<p>{MORE}", f"{LONG} {MORE}"),
        # names of a layout, not of a side block
        (f"<body><div class='has-sidebar'><p>{LONG}</p><div class='sidebar'>{MORE}</div></div>", LONG),
        (f"<div class='page with-comments'><article><p>{LONG}</p></article><div id='comments'><article>{MORE}</article></div></div>", LONG),
        (f"<div id='related-work'><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
        (f"<p>{LONG}</p><div class='related-posts'><p>{MORE}</p></div>", LONG),
        # a side name on what holds the page
        (f"<body>{NAV}<div class='widget'><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
        (f"<form action=x>{NAV}<main><p>{LONG}</p></main><input name=q></form>", LONG),
        (f"<div><p>{LONG}</p></div><form><p>{MORE}</p></form>", LONG),
        # a lead paragraph beside the block of the body; a closing one after main
        (f"<div class=lead>{LONG}</div><div class=body><p>{MORE}</p><p>{MORE}</p><p>Short.</p><p>{MORE}</p></div>", f"{LONG} {MORE} {MORE} Short. {MORE}"),
        (f"<main><p>{LONG}</p></main><div><p>{MORE}</p></div>", f"{LONG} {MORE}"),
        # several articles, none, unclosed and wrongly nested elements
        (f"<article><p>{LONG}</article><article><p>{MORE}</article><footer>f</footer>", f"{LONG} {MORE}"),
        (f"<p class=notice>We use cookies.<p>{LONG}<div><b>{MORE}</div></b>", f"{LONG} {MORE}"),
        (f"<p>{LONG} <span class='ad'>buy <span>now</span> here</span>end</p>", f"{LONG} end"),
        (f"<div class=comments><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></div><p>{LONG}</p>", LONG),
        ("<div class=menu>only a menu", "only a menu"),
    ],
)
def test_main_text_of_other_shapes(html, want):
    assert main_text.main_text(html) == want


def test_main_text_of_a_very_long_page():
    page = "<body>" + f"<div><p>{LONG}" * 20_000
    assert len(main_text.main_text(page)) == 20_000 * (len(LONG) + 1) - 1


def test_main_text_of_the_test_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in main_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])


def test_pages_without_html(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (None, None, "", "t"), (2, "u", "<p>a", "t")], "page_id bigint, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.extract(pages).collect()) == ["", "", "a"]
