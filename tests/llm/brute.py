"""Plain versions of corpus operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spelling(documents: list[tuple]) -> dict[str, tuple]:
    """``(doc_id, text)`` to ``word: (form, root, n, n_near, form_n)``."""
    n: Counter = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edited = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edited |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edited |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (edited & words.keys()) - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def repeats(documents: list[tuple], width: int = 100) -> list[tuple]:
    """``(doc_id, text)`` with distinct ids to sorted ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``."""
    rows = sorted(((d, (t or "").encode()) for d, t in documents), key=lambda r: (r[0] is not None, r[0]))
    seen: dict[bytes, tuple] = {}
    for k, (doc, raw) in enumerate(rows):
        for at in range(len(raw) - width + 1):
            seen.setdefault(raw[at : at + width], (k, at))
    out = []
    for k, (doc, raw) in enumerate(rows):
        gone = bytearray(len(raw))
        for at in range(len(raw) - width + 1):
            if seen[raw[at : at + width]] < (k, at):
                gone[at : at + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


GAP = " \t\n\x0b\x0c\r"


def damaged(rows: list[tuple]) -> list[tuple]:
    """``(conv_id, turn, role, text)`` after the faults."""
    out = []
    for conv_id, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv_id, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> tuple:
    """One conversation's ``(turn, role, text)`` in order to counts, cost, audit and digest, by trying all edits with the cheapest per state."""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(GAP)
        if not bare:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        elif bare[-1] not in ".!?":
            kinds.append("truncated")
        else:
            kinds.append("")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # state: last initial of the output; best (cost, audit, output) by state
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def grown(best: dict) -> dict:
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for c in legal[state]:
                    if c in full:
                        new = (cost + 5, audit + "I", [*out, f"{full[c]}:"])
                        if c not in best or new[:2] < best[c][:2]:
                            best[c] = new
        return best

    best = grown({"": (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds):
        nxt: dict = {}

        def offer(state: str, value: tuple) -> None:
            if state not in nxt or value[:2] < nxt[state][:2]:
                nxt[state] = value

        for state, (cost, audit, out) in best.items():
            offer(state, (cost + 2, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            if role[:1] and role[:1] in legal[state]:
                offer(role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
            for c in legal[state]:
                if c in full:
                    offer(c, (cost + more + 1, audit + "R", [*out, f"{full[c]}:{text}"]))
        best = grown(nxt)
    cost, audit, out = min(v for s, v in best.items() if s in ("", "a"))
    return (
        gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal,
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def conversations(rows: list[tuple]) -> dict:
    """``(conv_id, turn, role, text)`` to one result per conversation; ties by role, then digest of the text."""
    by_id: dict = {r[0]: [] for r in rows}
    for conv_id, turn, role, text in damaged(rows):
        by_id[conv_id].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {k: repaired(sorted(v, key=order)) for k, v in by_id.items()}
