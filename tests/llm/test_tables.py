"""Operators across rows: near copies, vectors, archives and the pipeline, against brute force."""

import collections
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from conftest_rows import prose
from placewright.llm import mixing, near_dup, secret_scan, vectors, warc
from placewright.llm.common import Stored, components


def groups(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    draw = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 200)] + [(draw.randint(300, 600), draw.randint(300, 600)) for _ in range(150)]
    frame = spark.createDataFrame([(b, a) if draw.random() < 0.5 else (a, b) for a, b in links], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(frame, Stored(spark, "test")).collect()}
    want = groups(links, {n for link in links for n in link if link[0] != link[1]})
    assert got == {n: r for n, r in want.items()}


def test_components_end_with_the_stars(spark):
    class Counted(Stored):
        tables = 0

        def table(self, rows, name):
            self.tables += 1
            return super().table(rows, name)

    # stars need no round, a path of three nodes one, and neither a further one that changes nothing
    for links, tables in [([(1, k) for k in range(2, 9)] + [(20, 21)], 1), ([(1, 2), (2, 3), (7, 8)], 5), ([], 1)]:
        stored = Counted(spark, "test")
        frame = spark.createDataFrame(links + links[:1], "a bigint, b bigint")
        got = sorted((r["node"], r["root"]) for r in components(frame, stored).collect())
        assert got == sorted(groups(links, {n for link in links for n in link}).items())
        assert stored.tables == tables


def test_second_links_join_whole_components(spark, monkeypatch):
    def edited(seed, *places):
        words = prose(5, 100).split()[:100]
        for k in places:
            words[k] = f"edit{seed}x{k}"
        return " ".join(words)

    # twelve texts of three copies lead most buckets and are like no other; the last six are like each other
    texts = {3 * k + copy: edited(f"lead{k}", 6 + k, 36 + k, 66 + k) for k in range(12) for copy in range(3)}
    texts.update({100 + k: edited(k, 10 + 14 * k) for k in range(6)})
    calls = []

    def seen(edges, stored):
        out = components(edges, stored)
        calls.append(({r[c] for r in edges.collect() for c in ("a", "b")}, {r["node"]: r["root"] for r in out.collect()}))
        return out

    monkeypatch.setattr(near_dup, "components", seen)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == {k: 100 if k >= 100 else k - k % 3 for k in texts}
    (_, first), (again, _) = calls
    assert first and again and all(first.get(node, node) == node for node in again)


def test_near_copies_equal_brute_force(spark):
    draw = random.Random(6)
    texts = {}
    for base in range(6):
        words = prose(base, 60 + 20 * base).split()
        for k in range(12):
            own = list(words)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = f"edit{draw.randint(0, 10**6)}"
            texts[base * 100 + k] = " ".join(own)
    passage = prose(77, 55)
    for k in range(700, 730):
        texts[k] = prose(k, 60) + " " + passage
    texts.update({900: "a b c d", 901: "a b c d", 902: "a b c e", 903: "", 904: "one"})
    values = {}
    for doc_id, text in texts.items():
        found = list(near_dup.text_shingles(pa.array([text])))
        values[doc_id] = found[0][2] if found else None
    links = []
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and values[a] is not None and values[b] is not None:
                shared = len(set(values[a].tolist()) & set(values[b].tolist()))
                total = len(values[a]) + len(values[b])
                aligned = near_dup.similarity(values[a], values[b])
                assert aligned <= shared / (total - shared) + 1e-9
                if aligned:
                    links.append((a, b))
    want = groups(links, ids)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == want and any(a != b for a, b in want.items())
    assert len({want[k] for k in range(700, 730)}) == 30


def test_alignment_is_by_order():
    one = np.arange(1, 101, dtype=np.uint64)
    assert near_dup.similarity(one, one) == 1.0
    assert near_dup.similarity(one, np.roll(one, 50)) == 0.0
    moved = np.concatenate([one[:40], one[45:60], one[40:45], one[60:]])
    assert abs(near_dup.similarity(one, moved) - 95 / 105) < 1e-9


def test_a_repeated_passage_meets_its_like(spark):
    p, q = prose(501, 14), prose(502, 80)
    texts = [(1, f"{p} {q} {p}"), (2, f"{q} {p}"), (3, prose(503, 94))]
    one, two = (v for _, _, v in near_dup.text_shingles(pa.array([t for _, t in texts[:2]]), labels=False))
    assert abs(near_dup.similarity(one, two) - 90 / 104) < 1e-9
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}


def test_alignment_equals_a_table_of_all_prefixes():
    draw = np.random.default_rng(8)
    for _ in range(200):
        one = draw.integers(0, int(draw.integers(2, 30)), int(draw.integers(1, 40))).astype(np.uint64)
        two = np.delete(one, draw.integers(0, len(one), 3)) if len(one) > 6 else one[::-1]
        row = [0] * (len(two) + 1)
        for x in one.tolist():
            above, row = row, [0]
            for k, y in enumerate(two.tolist()):
                row.append(above[k] + 1 if x == y else max(above[k + 1], row[k]))
        want = row[-1] / (len(one) + len(two) - row[-1])
        got = near_dup.similarity(one, two, 0.1)
        assert abs(got - (want if want >= 0.1 else 0.0)) < 1e-9
    many = np.zeros(20_000, np.uint64)
    assert near_dup.similarity(np.append(many, [1, 2]), np.append([3], many)) > 0.99


def test_banded_alignment_equals_the_whole_table():
    draw = np.random.default_rng(9)
    narrow = 0
    for _ in range(300):
        one = draw.integers(0, int(draw.integers(2, 60)), int(draw.integers(80, 160)))
        two = one.tolist()
        for _ in range(int(draw.integers(0, 30))):
            spot = int(draw.integers(0, len(two)))
            two[spot : spot + int(draw.integers(0, 2))] = draw.integers(0, 60, int(draw.integers(0, 2))).tolist()
        two = np.array(two)
        row = [0] * (len(two) + 1)
        for x in one.tolist():
            above, row = row, [0]
            for k, y in enumerate(two.tolist()):
                row.append(above[k] + 1 if x == y else max(above[k + 1], row[k]))
        left_out = len(one) + len(two) - 2 * row[-1]
        assert near_dup._common(one, two, left_out) == row[-1]
        assert near_dup._common(one, two, 1_000) == row[-1]
        assert near_dup._common(one, two, left_out - 1) <= row[-1]
        narrow += left_out < 32
    assert narrow > 100
    # places far apart in a long text, some shingles repeated: a band of a few hundred diagonals is enough
    long = draw.integers(0, 1 << 62, 150_000)
    long[::1_000] = 5
    other = np.delete(long, draw.integers(0, len(long), 200))
    lost = len(long) - len(other)
    assert near_dup.similarity(long, other) == pytest.approx(len(other) / (len(long) + len(other) - len(other)))
    assert near_dup._common(long, other, lost) == len(other)


def test_near_copies_of_odd_rows(odd, none):
    got = collections.defaultdict(list)
    for r in near_dup.near_duplicates(odd).collect():
        got[r["doc_id"]].append(r)
    assert [len(got[k]) for k in (1, 4, None)] == [1, 2, 2]
    assert {got[k][0]["group_id"] for k in (1, 2, 3)} == {1} and not got[2][0]["kept"] and not got[3][0]["kept"]
    assert all(got[k][0]["kept"] for k in (1, 4, 5, 6, 7, 8, 9, 11, 12)) and all(r["kept"] for r in got[None])
    assert near_dup.near_duplicates(none).count() == 0


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = []
    for group in range(30):
        centre = draw.standard_normal(24)
        for _ in range(int(draw.integers(1, 8))):
            rows.append((len(rows), (centre + draw.standard_normal(24) * 0.12).tolist(), group % 3))
    centre = draw.standard_normal(24)
    rows += [(len(rows) + k, (centre + draw.standard_normal(24) * 0.05).tolist(), 0) for k in range(700)]
    rows += [(5_000 + k, centre.tolist(), 0) for k in range(60)]
    odd = [(6_000, None, 1), (6_001, [0.0] * 24, 1), (6_002, [float("nan")] + [1.0] * 23, 1), (6_003, centre.tolist(), None), (6_004, [None] + [1.0] * 23, 1), (6_005, [], 1), (6_006, [1.0, 2.0], 1), (6_007, [2.0, 4.0], 1), (None, centre.tolist(), 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([x for *_, x in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b], ids)
    assert {k: got[k]["n_links"] for k in ids} == dict(zip(ids, near.sum(axis=1).tolist()))
    assert {k: got[k]["component_id"] for k in ids} == want
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (*range(6_000, 6_006), None))
    assert got[6_006]["n_links"] == got[6_007]["n_links"] == 1
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_more_passes_for_more_bits():
    assert [vectors.pass_count(k) for k in (0, 7, 13)] == [1, 14, 33]


def crowd(draw, count: int, pairs: int, mutual: float, dims: int = 64) -> np.ndarray:
    """Vectors of a common direction, the last ones near copies of the first at a cosine of 0.935."""
    centre = draw.standard_normal(dims)
    centre /= np.linalg.norm(centre)
    side = draw.standard_normal((count, dims))
    side -= np.outer(side @ centre, centre)
    side /= np.linalg.norm(side, axis=1)[:, None]
    out = np.sqrt(mutual) * centre + np.sqrt(1 - mutual) * side
    turn = draw.standard_normal((pairs, dims))
    turn -= (turn * out[:pairs]).sum(axis=1)[:, None] * out[:pairs]
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    return np.concatenate([out, 0.935 * out[:pairs] + np.sqrt(1 - 0.935**2) * turn])


@pytest.mark.parametrize("cell", [512, 64])
def test_no_link_is_lost_where_vectors_share_a_direction(spark, monkeypatch, cell):
    """Labels spread evenly and not; buckets in one partition and (with small cells) in parts."""
    monkeypatch.setattr(vectors, "CELL", cell)
    draw = np.random.default_rng(11)
    rows, near = [], 0
    for label, mutual in enumerate((0.0, 0.5, 0.7, 0.8)):
        unit = crowd(draw, 3_000, 300, mutual)
        near += int((unit @ unit.T >= 0.93).sum()) - len(unit)
        rows += [(len(rows) + k, v, label, k) for k, v in enumerate(unit.tolist())]
    # repeated rows, and a column that the operator makes itself
    frame = spark.createDataFrame(rows + rows[:1], "vec_id bigint, embedding array<double>, label int, kept int").repartition(5)
    got = vectors.near_vectors(frame).collect()
    assert len(got) == len(rows) + 1
    # both rows of the repeated id link with each other and with the copy of it, which links with both
    assert sum(r["n_links"] for r in got) == near + 4



def pages():
    same, other = "x" * 1_200, "é" * 600
    rows = [(k, f"http://h{k % 3}.Example.org/p{k % 5}" if k % 7 else None, (same, other, f"small {k % 2}\r\n\r\nWARC/1.1\r\n", None)[k % 4]) for k in range(120)]
    return rows + [(None, "u\r\nx", same), (3, "a", "y" * 1_500), (3, "b", "y" * 1_500), (1, "c", "y" * 1_500)]


def test_archives_equal_brute_force(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id bigint, url string, html string").repartition(5)
    got = warc.capture_histories(frame, f"{tmp_path}/archives").collect()
    keys = [(r["url_key"] or "", r["captured_at"], r["page_id"] is None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys)
    heads = {}
    for page_id, _, html in pages():
        if html and len(html.encode()) >= 1_000 and page_id is not None:
            heads[html] = max(page_id, heads.get(html, -1))
    want = []
    for page_id, _, html in pages():
        raw = (html or "").encode()
        again = html in heads and page_id != heads[html]
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", heads[html] if again else None))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert warc.capture_histories(frame.limit(0), f"{tmp_path}/none").count() == 0


def test_reading_members_and_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    two = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.records(warc.inflated(memoryview(two)))] == [b"a\r\n\r\n"] * 2
    assert list(warc.records(iter([b""]))) == []
    for broken in (record[:40], record[:55], b"no archive\r\n\r\n"):
        try:
            list(warc.records(iter([broken])))
        except ValueError:
            continue
        raise AssertionError(broken)


def test_loser_tree():
    draw = random.Random(1)
    for count in range(0, 9):
        lists = [sorted(draw.choices(range(30), k=draw.randint(0, 12))) for _ in range(count)]
        assert list(warc.LoserTree(lists)) == sorted(x for one in lists for x in one)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stored = Stored(spark, "test-pipeline")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored.table(stage(spark, before, folder), name.replace(" ", "-"))
        assert after.columns == docs.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        if name in ("secrets", "mix"):
            assert after.count() == before.count()
        if name == "secrets":
            hit = secret_scan.find_secrets(before, ["doc_id"]).where("size(spans) > 0").count()
            assert after.where("text like '%[secret]%'").count() == hit and after.where("n_chars <> length(text)").count() == 0
        before = after
    tokens = corpus_pipeline.run(spark, folder).select("doc_id", "source", "mix_position", "decoded_sha256").collect()
    # positions are the order of the mix, so their prefixes hold what its slots hold
    tokens.sort(key=lambda r: r["mix_position"])
    assert len({r["mix_position"] for r in tokens}) == len(tokens)
    slot = {r["doc_id"]: (r["slot"], r["place"], r["doc_id"]) for r in mixing.mix(before).collect()}
    assert [r["doc_id"] for r in tokens] == sorted(slot, key=slot.get)
    digest = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in before.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in tokens} == digest


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
