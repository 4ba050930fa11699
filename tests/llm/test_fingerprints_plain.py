"""I-Match fingerprints and their likeness against a plain computation in Python integers, over many ranges."""

import random

import numpy as np

from driftline.llm import fingerprints

MASK = (1 << 64) - 1


def plain(rows, band, densities, subsets):
    key = {w: int(fingerprints.terms([w]).__next__()[0]) for _, t in rows for w in (t or "").split()}
    sets = [({key[w] for w in (t or "").split()}) for _, t in rows]
    low, high = max(2.0, band[0] * len(rows)), max(2.0, band[1] * len(rows))
    lexicon = sorted(k for k in set().union(*sets) if low <= sum(k in s for s in sets) <= high)
    draw = np.random.default_rng(0)
    chosen = [{k for k, x in zip(lexicon, draw.random(len(lexicon)), strict=True) if x < 1 / d} for d in densities for _ in range(subsets)]

    def mark(text):
        own = sorted({key[w] for w in text.split() if w in key} & set(lexicon))
        if not own:
            return None
        out = []
        for subset in chosen:
            total, some = 0, [k for k in own if k in subset]
            for rank, k in enumerate(some, 1):
                mixed = (k ^ (rank * 0x9E3779B97F4A7C15 & MASK)) * 0xBF58476D1CE4E5B9 & MASK
                total = total + (mixed ^ (mixed >> 31)) & MASK
            out.append(max((total * 0x94D049BB133111EB & MASK) >> 48, 1) if some else 0)
        return out

    def likeness(a, b, same_text):
        if a is None or b is None:
            return float(same_text)
        best = 0.0
        for d in range(len(densities)):
            x, y = a[d * subsets : (d + 1) * subsets], b[d * subsets : (d + 1) * subsets]
            some = sum(p != 0 or q != 0 for p, q in zip(x, y, strict=True))
            best = max(best, sum(p == q != 0 for p, q in zip(x, y, strict=True)) / max(some, subsets // 2))
        return 1.0 if a == b else best

    return mark, likeness


def test_fingerprints_equal_a_plain_computation(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for i in range(80)] + [(90, None), (91, ""), (92, "q" * 7)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    band = (0.02, 0.3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df, band, per_range=500).collect()}
    assert len(got) == len(rows)
    mark, likeness = plain(rows, band, fingerprints.DENSITIES, fingerprints.SUBSETS)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        own = mark(t)
        if own is None:
            assert got[i]["fingerprint"].startswith("-")
        else:
            assert got[i]["fingerprint"] == "".join(f"{h:04x}" for h in own)
        changed = fingerprints.edited(t, after)
        assert abs(got[i]["near_next"] - likeness(own, mark(after), t == after)) < 1e-9
        # A cut word is a word of its own, which is in no lexicon.
        assert abs(got[i]["near_edited"] - likeness(own, mark(changed), t == changed)) < 1e-9


def test_repeated_rows_and_null_ids_over_ranges(spark):
    rows = [(None, "same words here")] * 40 + [(5, "same words here")] * 40 + [(1, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.fingerprints(df, per_range=50).collect()
    assert len(got) == len(rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) >= 39
    named = spark.createDataFrame([("b", "one two"), ("a", "one three")], "doc_id string, text string")
    assert {r["doc_id"] for r in fingerprints.fingerprints(named).collect()} == {"a", "b"}
