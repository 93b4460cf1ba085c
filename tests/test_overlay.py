"""Nested settings and unique names against sequential versions."""

import json
import random


from corvane.operators.overlay import overlay, unique_names



def merged(base, over):
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def test_overlays_of_random_trees_equal_recursive_ones(spark):
    own = random.Random(5)

    def grow(depth):
        if depth == 0 or own.random() < 0.35:
            return own.choice([1, 2.5, "x", None, True, [1, {"a": 2}], [], {}, {}])
        return {k: grow(depth - 1) for k in own.sample("abc", own.randint(0, 3))}

    rows, want = [], {}
    for i in range(300):
        layers = [grow(4) if own.random() > 0.05 else None for _ in range(own.randint(1, 4))]
        layers = [x if isinstance(x, dict) or x is None else {"a": x} for x in layers]
        out = {}
        for n, layer in enumerate(layers):
            rows.append((i, n, None if layer is None else json.dumps(layer)))
            out = merged(out, layer or {})
        want[i] = out
    frame = spark.createDataFrame(rows, "id int, layer int, body string").repartition(4)
    assert {r.id: json.loads(r.body) for r in overlay(frame).collect()} == want


def test_names_are_made_unique_as_one_after_the_other(spark):
    own = random.Random(7)
    names = ["a.pdf", "a-2.pdf", "a-3.pdf", "a-2-2.pdf", "b.pdf", "b", "b-2", "c.tar.gz", "-2.pdf", ".pdf", "a.txt", "a b-2.pdf", "a b.pdf"]
    rows, want = [], []
    for session in range(40):
        seen = set()
        for seq in range(own.randint(1, 30)):
            name = own.choice(names)
            stem, dot, ext = name.rpartition(".")
            stem, suffix = (stem, dot + ext) if stem else (name, "")
            found, n = name, 2
            while found in seen:
                found, n = f"{stem}-{n}{suffix}", n + 1
            seen.add(found)
            rows.append((session, seq, name))
            want.append((session, seq, name, found))
    got = unique_names(spark.createDataFrame(rows, "s int, q int, name string").repartition(5), "s", "q", "name")
    assert sorted(map(tuple, got.collect())) == want
