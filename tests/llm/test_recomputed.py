"""Language vectors, clusters and predictions, and quality scores, computed again in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagelark.llm import language_id as lang
from pagelark.llm import quality_mil

TEXTS = ["Hello, World 42!", "", "   ", "été à la plage -- déjà vu", "ÄÖÜ straße", "a", "漢字 and \U00010400\U0001F600 x", "aa aa  aa\naa", "Der Hund und die Katze", "El perro y el gato", "le chien et le chat"]


def grams(text):
    """Hashed features of one to three characters with their counts."""
    plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    found = Counter()
    for size in (1, 2, 3):
        for at in range(len(plain) - size + 1):
            part, gram = plain[at : at + size], 0
            if part == " ":
                continue
            for character, mix in zip(part, (2654435761, 2246822519, 3266489917)):
                gram = (gram * 31337 + ord(character) * mix) % (1 << 32)
                gram ^= gram >> 15
            found[(gram * 2654435769 % (1 << 32)) >> 19] += 1
    return found


def unit(counts, idf):
    weights = {f: math.log(1 + n) * idf[f] for f, n in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {f: w / length for f, w in weights.items()} if length else {}


def cosine(a, b):
    return sum(w * b.get(f, 0.0) for f, w in a.items())


def test_counts():
    for text, row in zip(TEXTS, lang.counts(TEXTS)):
        assert {int(f): int(row[f]) for f in np.flatnonzero(row)} == dict(grams(text)), text


def test_vectors():
    idf = np.linspace(0.5, 3.0, lang.DIM).astype(np.float32)
    rows = np.concatenate(list(lang.vectors(TEXTS, idf)))
    for text, row in zip(TEXTS, rows):
        want = unit(grams(text), idf.astype(float))
        assert {int(f) for f in np.flatnonzero(row)} == set(want) and all(row[f] == pytest.approx(w, rel=1e-4) for f, w in want.items())


def test_clusters_are_those_of_plain_spherical_k_means():
    draw = random.Random(3)
    points = []
    for axis in (0, 2, 4):
        for _ in range(20):
            p = [draw.random() * 0.2 for _ in range(6)]
            p[axis] += 1
            length = math.sqrt(sum(x * x for x in p))
            points.append([x / length for x in p])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    mean = [sum(c) / len(points) for c in zip(*points)]
    # the first centroid is the most typical point, each other one the point farthest from those before
    chosen = [max(points, key=lambda p: dot(p, mean))]
    while len(chosen) < 3:
        chosen.append(min(points, key=lambda p: max(dot(p, c) for c in chosen)))
    for _ in range(12):
        own = [max(range(3), key=lambda i: dot(p, chosen[i])) for p in points]
        sums = [[sum(c) for c in zip(*[p for p, o in zip(points, own) if o == i])] for i in range(3)]
        chosen = [[x / math.sqrt(dot(s, s)) for x in s] for s in sums]
    centroids, floors = lang.clusters(np.array(points, np.float32), 3)
    assert np.allclose(centroids, chosen, atol=1e-5)
    for i in range(3):
        members = sorted(dot(p, chosen[i]) for p, o in zip(points, own) if o == i)
        place = 0.01 * (len(members) - 1)
        assert floors[i] == pytest.approx(members[0] + place * (members[1] - members[0]), abs=1e-5)


def test_predictions_are_the_nearest_centroids(spark):
    words = {"x": ["hund", "katze", "straße", "und", "nicht"], "y": ["perro", "gato", "calle", "pero", "aunque"]}
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(words[code]) for _ in range(6)), code) for i, code in enumerate("xy" * 30)]
    model = lang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), centroids=2)
    seen = Counter(f for _, text, _ in rows for f in grams(text))
    centroids = [{int(f): float(c[f]) for f in np.flatnonzero(c)} for c in model.centroids]
    # a feature's weight falls with the number of documents that hold it, and with nothing else
    by_count = {}
    for f, n in seen.items():
        by_count.setdefault(n, set()).add(round(float(model.idf[f]), 5))
    assert all(len(v) == 1 for v in by_count.values())
    ranked = [min(by_count[n]) for n in sorted(by_count)]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) > 1
    texts = [" ".join(draw.choice(words[code]) for _ in range(4)) for code in "xyxyxy"]
    (found,) = model.predict(texts)
    for text, predicted, score in zip(texts, found["lang_pred"], found["score"]):
        near = [cosine(unit(grams(text), model.idf.astype(float)), c) for c in centroids]
        assert score == pytest.approx(max(near), abs=1e-4) and predicted == model.languages[near.index(max(near))]


def test_quality_scores_are_those_of_plain_gated_attention():
    rng = np.random.default_rng(4)
    labels = np.array([0.0, 1.0] * 20)
    size = rng.integers(1, 6, 40)
    bag = np.repeat(np.arange(40), size)
    codes = rng.normal(0, 1, (len(bag), 7))
    model = quality_mil.train(codes, bag, labels, epochs=3)
    p = model.weights
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    through = lambda x, w: [sum(a * float(w[i, j]) for i, a in enumerate(x)) for j in range(w.shape[1])]
    found = model.forward(codes, bag)
    for doc in range(40):
        hidden, logits = [], []
        for code in codes[bag == doc]:
            x = [max(-6, min(6, (float(c) - m) / s)) for c, m, s in zip(code, model.mean, model.scale)]
            h = [math.tanh(a + b) for a, b in zip(through(x, p["w"]), p["b"])]
            gated = [math.tanh(a) * sigmoid(b) for a, b in zip(through(h, p["v"]), through(h, p["u"]))]
            hidden.append(h)
            logits.append(sum(g * a for g, a in zip(gated, p["a"])))
        total = sum(math.exp(e) for e in logits)
        attention = [math.exp(e) / total for e in logits]
        z = [sum(a * h[i] for a, h in zip(attention, hidden)) for i in range(len(hidden[0]))]
        assert found["attention"][bag == doc] == pytest.approx(attention)
        assert found["score"][doc] == pytest.approx(sigmoid(sum(a * c for a, c in zip(z, p["c"])) + float(p["c0"])))


def test_training_lowers_the_loss():
    rng = np.random.default_rng(6)
    bag, labels = np.repeat(np.arange(60), 4), np.array([0.0, 1.0] * 30)
    codes = rng.normal(0, 1, (240, 5))
    codes[::4, 2] += 2 * labels
    losses = []
    for epochs in (1, 10, 40):
        score = quality_mil.train(codes, bag, labels, epochs=epochs).forward(codes, bag)["score"]
        losses.append(-np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score)))
    assert losses == sorted(losses, reverse=True)
