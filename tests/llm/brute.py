"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def string_dedup(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - width + 1):
            part = data[k : k + width]
            gone[k : k + width] |= part in seen
            seen.add(part)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, sha(np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def window_dedup(rows, width):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - width + 1):
            if first.setdefault(tuple(own[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(own), sum(gone), sha(" ".join(w for w, g in zip(own, gone, strict=True) if not g).encode()))
    return out


def shingles(text, n):
    own = words((text or "").translate(LOWER))
    return frozenset(tuple(own[k : k + n]) for k in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def similar(rows, n, percent):
    sets, up, post = {i: shingles(t, n) for i, t in rows}, {}, defaultdict(list)

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in post[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            post[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def counts(text):
    own, lines, seen, repeated = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        repeated += bool(words(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
    cover = {x for k in range(len(own) - 7) if windows[tuple(own[k : k + 8])] > 1 for x in range(k, k + 8)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(cover)


class PairModel:
    """Witten and Bell's pair model over counts rounded to the middle of doubling levels."""

    def __init__(self, rows):
        tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in rows}
        train = [own for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 10]
        self.one = Counter(w for own in train for w in own)
        self.total = sum(self.one.values())
        two = Counter(p for own in train for p in zip([None, *own], own))
        self.two = {p: (3 * 2 ** (c.bit_length() - 1) - 1) / 2 for p, c in two.items()}
        self.sum, self.kinds = Counter(), Counter()
        for (h, _), q in self.two.items():
            self.sum[h] += q
            self.kinds[h] += 1
        self.tokens = tokens

    def base(self, w):
        return (self.one[w] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))

    def after(self, h, w):
        return (self.two.get((h, w), 0) + self.kinds[h] * self.base(w)) / (self.sum[h] + self.kinds[h]) if self.sum[h] else self.base(w)

    def row(self, i):
        own = self.tokens[i]
        held = zlib.crc32(str(i).encode()) % 10 == 0
        return held, len(own), sum(self.one[w] > 0 for w in own), self.total, sum(math.log10(self.base(w)) for w in own), sum(math.log10(self.after(h, w)) for h, w in zip([None, *own], own))


def features(text_words, text):
    """The plain form of stats.FEATURES for some consecutive words of a text and the bytes from the first to the last of them."""
    n, some = len(text_words), max(len(text_words), 1)
    raw = text.encode()
    chars = max(len(text), 1)
    share = lambda members: sum(b in members for b in raw) / chars
    back = [sum(text_words[i] == text_words[i - k] for i in range(k, n)) / some for k in (1, 2)]
    return [
        math.log1p(n), len(text) / some, share(b"#*$%&|<>"), share(range(65, 91)), share(range(48, 58)), share(b".?,;:"), share(b"!"), share(b"{}[]()=/\\_@~^\""),
        1 - (n - len(set(text_words))) / some, *back, sum(len(w.encode()) > 24 for w in text_words) / some,
    ]


def spans(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def tree_features(text):
    at, found = spans(text), counts(text)
    some = max(found[0], 1)
    return [*features(words(text), (text or "")[at[0][0] : at[-1][1]] if at else ""), found[4] / some, found[3] / some]


def tree_score(trees, x):
    """One text through every tree, node by node."""
    margin = trees.base
    for root in trees.roots.tolist():
        node = root
        while trees.left[node] != node:
            node = int(trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
        margin += trees.value[node]
    return 1 / (1 + math.exp(-margin))


def attention_score(model, text, passage, buckets, hashed):
    """One text through the network, passage by passage; ``hashed`` gives a word's 64-bit hash."""
    at, own = spans(text), words(text)
    rows = []
    for k in range(0, max(len(own), 1), passage):
        some = own[k : k + passage]
        bag = np.zeros(buckets)
        for w in some:
            h = hashed(w)
            bag[h % buckets] += 1 if h >> 63 else -1
        rows.append([*features(some, text[at[k][0] : at[k + len(some) - 1][1]] if some else ""), *bag / math.sqrt(max(len(some), 1))])
    x = np.clip((np.array(rows) - model.mean) / model.spread, -8, 8)
    p, weights, states = model.p, [], []
    for row in x:
        h = np.tanh(row @ p["w"] + p["b"])
        weights.append(math.exp(float(np.tanh(h @ p["v"]) * (1 / (1 + np.exp(-(h @ p["u"])))) @ p["a"])))
        states.append(h)
    z = sum(w * h for w, h in zip(weights, states, strict=True)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))
