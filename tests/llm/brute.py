"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def removed(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def groups(docs: dict[int, str | None], size: int, percent: int) -> dict[int, int]:
    """Component of each document by comparing all pairs that share a shingle."""
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets = {d: shingles(t, size) for d, t in docs.items()}
    holders = defaultdict(list)
    for d in sorted(docs):
        common = Counter(o for s in sets[d] for o in holders[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in docs}


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def redacted(text: str, mark: str) -> str:
    out, at = "", 0
    for a, _, b in secrets(text):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def encoder():
    import base64

    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def kneser_ney(rows, discount, shared, shared_pairs, factor):
    """Weights of words, and of pairs (history, word) as a whole, from (text, toxic) rows."""
    counts, kinds = [{}, {}], {}
    for text, toxic in rows:
        words = text.split()
        for p in {*zip(["", *words], words)}:
            counts[toxic][p] = counts[toxic].get(p, 0) + 1
            kinds[p] = None
    follows = [{}, {}]
    histories, everyone = [{}, {}], {}
    for p in kinds:
        everyone[p[1]] = everyone.get(p[1], 0) + 1
        for c in (0, 1):
            if p in counts[c]:
                follows[c][p[1]] = follows[c].get(p[1], 0) + 1
                histories[c][p[0]] = histories[c].get(p[0], 0) + counts[c][p]
    n = sum(everyone.values())

    def beyond(rate):
        d = math.log(rate[1] / rate[0])
        return math.copysign(max(abs(d) - math.log(factor), 0), d)

    def of_word(w):
        share = everyone[w] / n
        own = [max(f.get(w, 0) - discount, 0) + discount * len(f) * share for f in follows]
        return [(x + shared) / (sum(f.values()) * share + shared) for x, f in zip(own, follows)]

    def of_pair(p):
        h = [x.get(p[0], 0) for x in histories]
        back = discount * sum(q[0] == p[0] for q in kinds) / sum(h) * everyone[p[1]] / n
        seen = [c.get(p, 0) for c in counts]
        rates = of_word(p[1])
        return [(max(seen[c] - discount, 0) + back * h[c] * rates[c] + shared_pairs * rates[c]) / (sum(seen) * h[c] / sum(h) + shared_pairs) for c in (0, 1)]

    words = {w: beyond(of_word(w)) for w in everyone}
    return words, {p: beyond(of_pair(p)) for p in kinds if p[0]}
