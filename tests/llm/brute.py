"""Brute-force versions of the operators: plain Python on small inputs, written from the definitions alone."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_components(rows, words: int, num: int, den: int) -> dict:
    """doc_id: (size of the shingle set, smallest doc_id of the component)."""
    sets: dict = {}
    for doc, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            new, old = sorted((label[a], label[b]))
            label = {d: new if x == old else x for d, x in label.items()}
    return {d: (len(sets[d]), label[d]) for d in sets}


def secrets(text: str | None) -> dict:
    """Base spans by the contract's patterns, and the added entropy spans, by counting each window anew."""
    from spanveil.llm import secret_scan as S

    text = text or ""
    base = []
    for order, (kind, rx, flags, group, least) in enumerate(
        (
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
            ("hex", r"[0-9a-f]+", 0, 0, 32),
        )
    ):
        base += [(m.start(), order, kind, m.end()) for m in re.finditer(rx, text, flags) if len(m[group]) >= least]
    base.sort()
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s = m[0]
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s, re.A) for p in S.ALLOWED):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "entropy_base64"
        width, least = S.CLASSES[kind]
        windows = (Counter(s[i : i + width]).values() for i in range(len(s) - width + 1))
        best = max(math.log2(width) - sum(c * math.log2(c) for c in w) / width for w in windows)
        if best >= least and not any(b[0] < m.end() and b[3] > m.start() for b in base):
            more.append((m.start(), 3, kind, m.end()))
    write = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    count = Counter(k for _, _, k, _ in base)
    return {"n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"], "base_sha256": hashlib.sha256(write(base).encode()).hexdigest(), "spans": write(base + more), "n_entropy": len(more)}


def pieces_of(rows, tokenizer, room: int = 1024, end_id: int = 2) -> list:
    """(doc_id, piece, start, length, ids_crc32) of every row."""
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % room or room
        cuts = [0, *range(first, len(ids) + 1, room)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out)


def label_shares(emit: np.ndarray, move: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Mean label marginals of the counted places of one sequence, by summing over all label paths."""
    length, n = emit.shape
    total, share = 0.0, np.zeros((length, n))
    for path in itertools.product(range(n), repeat=length):
        p = math.exp(sum(emit[i, c] for i, c in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, c in enumerate(path):
            share[i, c] += p
    return (share / total)[counted].mean(0)


def best_paths(emit: np.ndarray, step: np.ndarray) -> set:
    """All state paths of the greatest score, by trying every one; the last row of ``step`` is the start."""
    length, n = emit.shape
    scored = {}
    for path in itertools.product(range(n), repeat=length):
        scored[path] = step[-1, path[0]] + sum(emit[i, c] for i, c in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))
    best = max(scored.values())
    return {p for p, x in scored.items() if x >= best - 1e-9}


def template_of(text: str | None) -> list:
    """(core, class) of the template tokens of a text: class is number, unit, name, maybe (a capital that opens a sentence) or word."""
    from spanveil.llm.decontamination import UNITS

    out, number, before = [], False, None
    for line in (text or "").split("\n"):
        before = None
        for raw in WORD.findall(line):
            m = re.search(r"[0-9A-Za-z\x80-\U0010ffff%](?:.*[0-9A-Za-z\x80-\U0010ffff%])?", raw)
            if not m:
                continue
            core = m[0].lower()
            if re.fullmatch(r"[0-9.,:/+-]*", core) and re.search("[0-9]", core):
                kind = "number"
            elif number and core in UNITS:
                kind = "unit"
            elif m[0][0].isupper():
                kind = "name" if before is not None and not re.search(r"[.!?:;\"'()]$", before) else "maybe"
            else:
                kind = "word"
            number = kind == "number"
            out.append((core, kind))
            before = raw
    return out


def _readings(tokens: list, k: int):
    """(first token, key, names at their places, plain words) of every window of k template tokens, in each reading."""
    mark = {"number": "<n>", "unit": "<u>", "name": "<name>"}
    for i in range(len(tokens) - k + 1):
        w = tokens[i : i + k]
        keys = [mark.get(kind, core) for core, kind in w]
        names = [core if kind == "name" else None for core, kind in w]
        plain = sum(kind in ("word", "maybe") for _, kind in w)
        yield i, ("exact", *(core for core, _ in w)), None, k
        if k >= 3:
            if plain >= 2:
                yield i, tuple(keys), names, plain
            if w[0][1] == "name" and plain + 1 >= 2:
                yield i, (w[0][0], *keys[1:]), [None, *names[1:]], plain + 1
            if w[0][1] == "maybe" and plain - 1 >= 2:
                yield i, ("<name>", *keys[1:]), [w[0][0], *names[1:]], plain - 1


def leaks(docs, items, cover: float = 0.5) -> dict:
    """doc_id: sorted item_ids that it holds, by the operator's rule spelled out window by window."""
    out = {doc: [] for doc, _ in docs}
    for item, text in items:
        own = template_of(text)
        n, plain = len(own), sum(kind in ("word", "maybe") for _, kind in own)
        if not n:
            continue
        k = min(n, 8)
        wanted: dict = {}
        for i, key, names, words in _readings(own, k):
            wanted.setdefault(key, []).append((i, names, words))
        runs = {tuple(c for c, _ in own[i : i + 13]) for i in range(n - 12)}
        for doc, body in docs:
            tokens = template_of(body)
            strong, every, run = set(), {}, any(tuple(c for c, _ in tokens[i : i + 13]) in runs for i in range(len(tokens) - 12))
            for j, key, names, _ in _readings(tokens, k):
                for i, theirs, words in wanted.get(key, ()):
                    pairs = {(a, b) for a, b in zip(theirs or (), names or ()) if a is not None}
                    if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
                        continue
                    places = set(range(i, i + k))
                    every.setdefault(j - i, set()).update(places)
                    if names is None or words >= min(5, k):
                        strong |= places
            whole = plain >= 4 and any(len(x) >= 0.9 * n for x in every.values())
            if run or whole or (strong and len(strong) >= cover * n):
                out[doc].append(item)
    return {d: sorted(set(x)) for d, x in out.items()}
