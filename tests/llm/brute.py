"""Plain reference computations that the operators are held against."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = SPACE.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_components(docs, size, share):
    sets = {i: shingles(t, size) for i, t in docs}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= share * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def straddling_group(rng, size, alone, pairs):
    """Texts on one template at a similarity of 0.77 to 0.79, with pairs at 0.80 to 0.82 among them."""
    n = 200 * size
    template = [f"t{rng.randrange(10**9)}" for _ in range(n)]

    def text(edits):
        return " ".join(edits.get(k, w) for k, w in enumerate(template))

    def edits(count, taken=()):  # far enough apart that each changes ``size`` shingles
        out = dict(taken)
        while len(out) < count:
            k = rng.randrange(size, n - size)
            if all(abs(k - j) >= size for j in out):
                out[k] = f"e{rng.randrange(10**9)}"
        return out

    texts = [text(edits(13)) for _ in range(alone)]
    for k in range(pairs):
        both = edits(2 + k % 2)
        texts += [text(edits(13, both)), text(edits(13, both))]
    rng.shuffle(texts)
    return texts


def repeats(docs, length=50):
    data = {i: (t or "").encode() for i, t in docs}
    least = {}
    for i in sorted(data):
        b = data[i]
        for p in range(len(b) - length + 1):
            least.setdefault(b[p : p + length], i)
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def top_k(vectors, k):
    ok = [(i, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def crc_mod3(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def toxicity(text, weights, coef, none, fold, fold_light):
    """The score of words looked up one by one, without an automaton or exceptions."""
    word, found = re.compile(r"[^\W_]+"), []
    for mark, folded in (("", fold(text)), ("~", "" if text.isascii() else fold_light(text))):
        for w in word.findall(folded):
            if not mark or not w.isascii():
                best = [weights.get(f"{mark}{w}$", 0.0), *(weights.get(mark + w[:n], 0.0) for n in range(1, len(w) + 1))]
                found += [max(best)] if max(best) else []
    if not found:
        return none
    total, hundreds = sum(found), fold(text).count(" ") / 100
    z = coef[0] + sum(c * m for c, m in zip(coef[1:], (max(found, default=0.0), math.log1p(total), total / (1 + hundreds), math.log1p(hundreds))))
    return 1 / (1 + math.exp(-z))


def overlap(text, item, window, share, least):
    """Most equal tokens over any window of any alignment that reaches the share, or 0."""
    size, best = min(window, len(item)), 0
    if len(item) < least:
        return 0
    for i in range(len(item) - size + 1):
        for j in range(len(text) - size + 1):
            best = max(best, sum(a == b for a, b in zip(item[i : i + size], text[j : j + size])))
    return best if best >= share * size else 0
