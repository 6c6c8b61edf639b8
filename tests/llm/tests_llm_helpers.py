"""Plain versions of the operators, for the tests."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash

from tidemark.llm import bpe, secrets


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(texts, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for item, t in items:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lens = sorted({len(w) for w in windows})
    out = []
    for t in texts:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                moved = True
    return label


def close_pairs(fps):
    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 2):
            yield i, i + 1 + int(j)


def brute_secrets(text):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 12]
    base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s) for p in secrets.ALLOWED):
            continue
        kind = "entropy_hex" if re.search(secrets.CLASSES["entropy_hex"][0], s) else "entropy_text"
        s = s.lower() if kind == "entropy_hex" else s
        for i in range(len(s) - 19):
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values())
            if h >= secrets.CLASSES[kind][2]:
                a, b = m.start() + i, m.start() + i + 20
                if more and more[-1][0] == kind and more[-1][2] >= a and more[-1][1] >= m.start():
                    more[-1] = (kind, more[-1][1], b)
                else:
                    more.append((kind, a, b))
    order = lambda x: (x[1], secrets.KINDS.index(x[0]), x[2])
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))
    n = Counter(k for k, _, _ in base)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(say(base).encode()).hexdigest(), say(base + more)
