"""The toxicity score worked out by plain loops, from the definition alone: nothing here calls the operator."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

PRIOR, DRIFT = 20.0, 0.5


def by_definition(s):
    """Maximal segments of a short list: each of positive score, better than all segments within it, and in no longer one like it."""
    n = len(s)
    within = lambda i, j: [(a, b) for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j)]
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if sum(s[i:j]) > 0 and all(sum(s[a:b]) < sum(s[i:j]) for a, b in within(i, j))]
    return [(i, j, sum(s[i:j])) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good)]


def best_then_sides(s):
    """The same for long lists: take the best segment (of equal ones the shortest, then the first), then look left and right of it."""
    out, todo = [], [(0, len(s))]
    while todo:
        low, high = todo.pop()
        best, run, start = (0.0, 0, 0, 0), 0.0, low
        for i in range(low, high):
            if run <= 0:
                run, start = 0.0, i
            run += s[i]
            if (run, -(i + 1 - start)) > best[:2]:
                best = (run, -(i + 1 - start), start, i + 1)
        if best[0] > 0:
            out.append((best[2], best[3], best[0]))
            todo += [(low, best[2]), (best[3], high)]
    return sorted(out)


def units(word):
    return [word[:k] for k in (3, 4, 5, 6, 7, 8) if k < len(word)] + [word + "$"]


class Plain:
    """Learnt from (doc_id, text) rows and (doc_id, toxic) labels, all of them (the sample's bound must not be reached)."""

    def __init__(self, docs, labels):
        toxic = defaultdict(int)
        for doc_id, label in labels:
            if doc_id is not None and label is not None and zlib.crc32(str(doc_id).encode()) % 5:
                toxic[doc_id] = max(toxic[doc_id], int(label > 0))
        rows = defaultdict(int)  # a text counts once
        for doc_id, text in docs:
            if doc_id in toxic:
                rows[text] = max(rows[text], toxic[doc_id])
        fold = {t: 42 % 4 if t is None else xxhash.xxh64_intdigest(t[:40].encode(), 42) % 4 for t in rows}
        self.counts = defaultdict(Counter)  # unit -> (toxic, fold) -> texts' distinct words
        self.sums = Counter()
        for text, label in rows.items():
            for word in set(self.words(text)):
                self.sums[label, fold[text]] += 1
                for u in units(word):
                    self.counts[u][label, fold[text]] += 1
        c = lambda u, label: sum(self.counts[u][label, f] for f in range(4))
        share = sum(n for (label, _), n in self.sums.items() if label) / sum(self.sums.values())
        self.useful = {u for u in self.counts if c(u, 1) >= 2 and c(u, 0) + c(u, 1) >= 4 and c(u, 1) > 1.2 * share * (c(u, 0) + c(u, 1))}
        by_fold = [self.chosen([f for f in range(4) if f != out]) for out in range(4)]
        self.scores = self.chosen(range(4))

        self.measured = []
        for text, label in rows.items():
            s = [self.token(w, by_fold[fold[text]]) for w in self.words(text)]
            self.measured.append((label, s, [x[2] for x in best_then_sides(s)]))
        tokens = [x if x > 0 else -DRIFT for label, s, _ in self.measured if not label for x in s]
        low, high = 1e-3, 1e-3
        above = lambda x: sum(n * math.exp(min(x * v, 700)) for v, n in Counter(tokens).items()) / max(len(tokens), 1) >= 1
        while not above(high) and high < 20:
            high *= 1.5
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if above(mid) else (mid, high)
        self.lam = low
        tops = sorted(x for label, _, own in self.measured if not label for x in own)
        half = (len(tops) - 1) / 2
        cut = (tops[math.floor(half)] + tops[math.ceil(half)]) / 2 if tops else 1.0
        # Segments that equal the median may come out on either side of it, by the order in which their tokens are summed.
        self.bounds = [max(1e-9, sum(x >= cut + side for x in tops) / max(1.0, len(tokens) * math.exp(-self.lam * cut))) for side in (1e-9, -1e-9)]
        self.settle(self.bounds[1])

    def settle(self, k):
        self.k = k
        self.features = [(label, *self.evidence(len(s), own)) for label, s, own in self.measured]

    @staticmethod
    def words(text):
        return re.findall(r"\w+", (text or "").lower())

    def chosen(self, folds):
        """Scores of the units of a model that has seen these folds."""
        count = lambda u, label: sum(self.counts[u][label, f] for f in folds)
        toxic, rest = (sum(self.sums[label, f] for f in folds) for label in (1, 0))
        root = min(max(toxic / max(toxic + rest, 1), 1e-6), 1 - 1e-6)
        logit = lambda p: math.log(p / (1 - p))

        def centre(u):
            """What the next shorter prefix says without this unit's own tokens."""
            stem = u[:-1][:8]
            if len(stem) < 3 or stem not in self.useful:
                return root
            bad, good = (max(count(stem, label) - count(u, label), 0) for label in (1, 0))
            return (bad + PRIOR * centre(stem)) / (bad + good + PRIOR)

        score = {}
        for u in self.useful:
            p = (count(u, 1) + PRIOR * centre(u)) / (count(u, 1) + count(u, 0) + PRIOR)
            score[u] = logit(min(max(p, 1e-6), 1 - 1e-6)) - logit(root)
        clear = {u for u in score if score[u] > 0.7}
        mended = {u for u in score if clear.intersection(units(u.removesuffix("$")))}
        return {u: score[u] if u in clear else max(0.0, score[u]) for u in clear | mended}

    def token(self, word, scores):
        known = [scores[u] for u in units(word) if u in scores]
        return (known[-1] if known else 0.0) - DRIFT

    def evidence(self, n, segments):
        """log(1 + -log p) of the best segment, and log(1 + the significant segments' bits)."""
        bits = [self.lam * x - math.log(self.k * max(n, 1)) for x in segments]
        if not bits:
            return 0.0, 0.0
        best = max(bits)
        if best < 14:  # beyond, the chance of such a segment is its expected number
            best = -math.log(1 - math.exp(-math.exp(min(-best, 700))))
        return math.log1p(best), math.log1p(sum(b for b in bits if b > 0))

    def loss(self, link):
        """What the link minimises: the log loss of the training texts and a small penalty, with slopes of zero or above."""
        out = sum(r * w * w / 2 for r, w in zip((1e-6, 0.05, 0.05), link, strict=True))
        for label, best, total in self.features:
            z = link[0] + link[1] * best + link[2] * total
            out += math.log1p(math.exp(-abs(z))) + max(z, 0) - label * z
        return out

    def probability(self, text, link):
        s = [self.token(w, self.scores) for w in self.words(text)]
        best, total = self.evidence(len(s), [x[2] for x in best_then_sides(s)])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, link[0] + link[1] * best + link[2] * total))))


def agrees(model, plain):
    """The operator's learnt numbers are the plain ones, and no small move of its link lowers the loss."""
    assert model.scores.keys() == plain.scores.keys()
    assert all(abs(model.scores[u] - x) < 1e-9 for u, x in plain.scores.items())
    assert math.isclose(model.lam, plain.lam, rel_tol=1e-6)
    assert plain.bounds[0] * (1 - 1e-5) <= model.k <= plain.bounds[1] * (1 + 1e-5)
    plain.settle(model.k)
    least = plain.loss(model.link)
    for i in range(3):
        for move in (-1e-3, 1e-3):
            link = [x + move * (i == j) for j, x in enumerate(model.link)]
            assert min(link[1:]) < 0 or plain.loss(link) >= least - 1e-7
