"""Plain Python versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def simhash(text):
    words = space_words(text)
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Node to the smallest node reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(rows):
    """doc_id to component_id for (doc_id, text)."""
    prints = {key: simhash(text) for key, text in rows}
    return components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def contamination(text, items):
    """(n_words, n_hit, item ids) for items (item_id, text)."""
    words = plain_words(text)
    hit, found = set(), set()
    for item, content in items:
        own = plain_words(content)
        width = min(13, len(own))
        for i in range(len(own) - width + 1 if own else 0):
            for at in range(len(words) - width + 1):
                if words[at : at + width] == own[i : i + width]:
                    hit.update(range(at, at + width))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def log_kt(zeros, ones):
    value, a, b = 0.0, 0, 0
    for _ in range(zeros):
        value += math.log((a + 0.5) / (a + b + 1))
        a += 1
    for _ in range(ones):
        value += math.log((b + 0.5) / (a + b + 1))
        b += 1
    return value


class ContextTree:
    """Weighted context tree by its definition: counts in dictionaries, recursion over depths."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, {}, {}
        for text in texts:
            padded = b"\n" * depth + text
            for i in range(depth, len(padded)):
                for node, bit in self.bits(padded[i]):
                    for d in range(depth + 1):
                        context = padded[i - d : i]
                        self.counts.setdefault((context, node), [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((context[1:], node), set()).add(context)
        self.known = {}

    @staticmethod
    def bits(byte):
        return [(1 << j | byte >> (8 - j), byte >> (7 - j) & 1) for j in range(8)]

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = log_kt(*self.counts.get((context, node), (0, 0)))
            if len(context) < self.depth:
                longer = self.longer(context, node)
                top = max(own, longer)
                own = top + math.log(math.exp(own - top) + math.exp(longer - top)) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def longer(self, context, node):
        return sum(self.weighted(c, node) for c in self.children.get((context, node), ()))

    def probability(self, full, node, bit, d=0):
        context = full[len(full) - d :]
        counts = self.counts.get((context, node), (0, 0))
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == self.depth:
            return own
        trust = 1 / (1 + math.exp(min(700, self.longer(context, node) - log_kt(*counts))))
        return trust * own + (1 - trust) * self.probability(full, node, bit, d + 1)

    def score(self, text):
        padded = b"\n" * self.depth + text
        return sum(
            math.log10(self.probability(padded[i - self.depth : i], node, bit))
            for i in range(self.depth, len(padded))
            for node, bit in self.bits(padded[i])
        )


def audit(docs, labels):
    """Rows of the filter audit for docs (key, text, part) and labels (key, quality, toxic), order by order."""
    texts = [(k, t or "", p or "") for k, t, p in docs]
    fails = []
    for key, text, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append(
            {
                "A": len(words) < 50,
                "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": key is not None and any(k is not None and k < key and t == text for k, t, _ in texts),
            }
        )
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, x in labels if x == 1}
    found, removed = {}, {}
    for part in {p for _, _, p in texts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [i for i, row in enumerate(texts) if row[2] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                out = [i for i in left if fails[i][letter]]
                again = [i for i in gone if fails[i][letter]]
                left = [i for i in left if i not in out]
                gone += out
                alone = [
                    i
                    for i, row in enumerate(texts)
                    if row[2] == part and fails[i][letter] and sum(fails[i].values()) == 1
                ]
                found[part, order, step] = (
                    letter,
                    len(left),
                    len(out),
                    len(again),
                    len(alone),
                    sum(texts[i][0] in good for i in out),
                    sum(texts[i][0] in toxic for i in out),
                )
                removed[part, letter] = removed.get((part, letter), 0) + len(out)
    return {place + row + (removed[place[0], row[0]],) for place, row in found.items()}


def sample_plan(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(key, n_features, weight, score, rank) for docs (key, text) and a list of target texts."""

    def features(text):
        words = plain_words(text)
        return len(words), [
            " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
        ]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for feature in features(text)[1]:
                held[bucket(feature)] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
        for b in range(buckets)
    ]
    found, able = [], []
    for place, (key, text) in enumerate(docs):
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([key, len(own), weight, score, None])
        if words >= least:
            able.append((-score, key is None, key or 0, weight, len(own), place))
    for rank, row in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        found[row[-1]][4] = rank
    return [tuple(row) for row in found]


def tightest(rooms, needed):
    """The smallest room that is large enough, or None."""
    return min((r for r in rooms if r >= needed), default=None)
