"""The clustering in plain Python over a few elements: what the Spark results are tested against."""

import math


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def term_distance(a, b):
    return levenshtein(a, b) / max(len(a), len(b), 1)


class Plain:
    """numerics: lists of coordinate names, with weights; categoricals: names, with weights."""

    def __init__(self, numerics, categoricals, m):
        self.numerics, self.categoricals, self.m = numerics, categoricals if m else [], m
        self.coords = [c for names, _ in numerics for c in names]

    def distance(self, a, b):
        terms = [w * math.sqrt(sum((a[c] - b[c]) ** 2 for c in names)) / math.sqrt(2) for names, w in self.numerics]
        terms += [w * term_distance(a[c], b[c]) for c, w in self.categoricals]
        return sum(terms) / len(terms)

    def nearest(self, p, cents):
        return min(((self.distance(p, c), -i) for i, c in cents.items()))

    def groups(self, points, cents):
        out = {}
        for p in points:
            out.setdefault(-self.nearest(p, cents)[1], []).append(p)
        return out

    def medoid(self, group, c):
        sample = [p[c] for p in sorted(group, key=lambda p: p["id"])[: self.m]]
        mean = [round(sum(term_distance(t, u) for u in sample) / len(sample), 12) for t in sample]
        return sample[min(range(len(sample)), key=lambda i: (mean[i], -i))]

    @staticmethod
    def byte_mean(group, c):
        terms = [p[c].encode() for p in group]
        signed = [sum(t[i] - 256 if t[i] > 127 else t[i] for t in terms) for i in range(min(map(len, terms)))]
        return bytes(int(s / len(terms)) & 255 for s in signed).decode(errors="replace")

    def run(self, points, seeds, mode, epsilon, most):
        cents = dict(enumerate(seeds))
        for it in range(1, most + 1):
            new = {}
            for i, group in self.groups(points, cents).items():
                new[i] = {c: sum(p[c] for p in group) / len(group) for c in self.coords}
                for c, _ in self.categoricals:
                    new[i][c] = self.medoid(group, c) if mode == "Standard" else self.byte_mean(group, c)
            moved = any(self.distance(new[i], cents[i]) > epsilon for i in new)
            cents = new
            if not moved:
                break
        return cents, it

    def quality(self, points, cents):
        stats = {}
        for p in points:
            d, i = self.nearest(p, cents)
            stats.setdefault(-i, []).append(d)
        keys = sorted(cents)
        pairs = [self.distance(cents[i], cents[j]) for i in keys for j in keys if i < j]
        intra = sum(map(sum, stats.values())) / len(points)
        return sum(pairs) / len(pairs) if pairs else None, intra, {i: (len(d), sum(d) / len(d)) for i, d in stats.items()}
