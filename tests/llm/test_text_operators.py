"""Text operators against brute force, exact round trips and held-out accuracy; nulls, empties, ties, repeats, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, fingerprints, language_id, lm_score, mixing, ngram_join, pieces, quality, shingles, suffix_dedup, toxicity
from driftline.llm.components import connected_components
from driftline.llm.registry import oracle_sql, queries

SPACE = "[\x20\x09-\x0d]"
WORDS = ["the", "of", "alpha", "béta", "Gamma", "日本", "omega", "x", "river", "stone", "cloud", "tree"]


def corpus(seed: int, n: int, words=WORDS) -> list[tuple]:
    """Texts with shared passages, exact and near copies, empties and nulls; ids in no order."""
    draw = random.Random(seed)
    say = lambda k: " ".join(draw.choice(words) + str(draw.randint(0, 9)) for _ in range(k))
    passages = [say(draw.randint(8, 40)) for _ in range(5)]
    texts = [None, "", "  \n\t", "a", "a b c d", "a  b\nc d", "z" * 99, "z" * 100, "z" * 140]
    while len(texts) < n:
        r = draw.random()
        if r < 0.15 and len(texts) > 20:
            texts.append(draw.choice(texts[9:]))
        elif r < 0.45 and len(texts) > 20:
            own = (draw.choice(texts[9:]) or "a").split(" ")
            own[draw.randrange(len(own))] = say(1)
            texts.append(" ".join(own))
        else:
            texts.append("\n".join(draw.choice(passages) if draw.random() < 0.4 else say(draw.randint(1, 40)) for _ in range(draw.randint(1, 5))))
    return [(i * 7919 % 100_003, t) for i, t in enumerate(texts)]


def frame(spark, rows, parts: int = 3):
    """The rows with columns whose names clash with those that operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumn("size", F.lit(-1)).withColumn("key", F.lit("k")).withColumn("kept", F.lit(False)).withColumn("n", F.lit(None).cast("int"))


def empty(spark):
    return frame(spark, [(1, "a")], 1).limit(0)


# --- exact dedup


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for _, i in g}


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, bits):
    rows = corpus(1, 90)
    got = exact_dedup.exact_dedup(frame(spark, rows), bits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == expected_exact(rows) and len(got) == len(rows)


def test_exact_dedup_repeats_nulls_and_nothing(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(5, "a"), (5, "a"), (None, "a"), (None, None), (7, "")])).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got} == {5, 7}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# --- mixing


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got[None] == 100 and sum(got.values()) == pytest.approx(1.5 * 2150)
    assert got["b"] / got["c"] == pytest.approx(2.0)


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(draw.randint(0, 30))) if i % 17 else None, f"s{min(i % 7, 4)}" if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix(docs, per_slice=40).collect()
    assert len(got) == 600 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - goal) <= 60 for t, goal in by.values())
    again = mixing.mix(docs.repartition(5), per_slice=40).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- n-gram join


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def shingle_set(t):
    w = words_of(t)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("rounds", [1, 3])
def test_ngram_join(spark, rounds):
    rows = corpus(3, 120)
    base = " ".join(f"w{i}" for i in range(60)).split()
    for k in range(40):  # a chain of near copies, each a word further from the first
        base[k] = f"v{k}"
        rows.append((200_000 - k, " ".join(base)))
    got = ngram_join.ngram_join(frame(spark, rows), rounds=rounds, crowd=0.0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected_components(rows)


def test_ngram_join_defined_cases(spark):
    got = ngram_join.ngram_join(frame(spark, [(3, "a b"), (3, "a b"), (2, "A  b"), (None, "a b"), (9, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2), (8, 0, 8), (9, 0, 9)]
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    assert ngram_join.ngram_join(frame(spark, [(1, None), (2, " ")])).where("component_id = doc_id and n_shingles = 0").count() == 2


def test_long_texts_hash_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(WORDS) for _ in range(500)).encode() + b"y" * 300
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert (shingles.word_hashes(text) == whole).all()


def test_components_of_chains_and_stars(spark, tmp_path):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("500", f"{i}") for i in range(501, 520)] + [("700", "700")]
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), str(tmp_path)).collect()
    assert {r["node"]: r["root"] for r in got} == {f"{i:03}": "000" for i in range(61)} | {f"{i}": "500" for i in range(500, 520)}


# --- suffix dedup


def expected_spans(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 2000])
def test_suffix_dedup(spark, shard):
    rows = [(i, t or "") for i, t in corpus(4, 100)]
    rows += [(300_000, "ab" * 400), (300_001, "ab" * 60)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), shard=shard).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == expected_spans(rows)


def test_suffix_dedup_merges_lists_by_binary_search():
    draw = np.random.default_rng(3)
    lists, plain = [], {}
    for _ in range(5):
        word = np.unique(draw.integers(0, 60, 40)).astype(np.uint64) << np.uint64(56)
        place = draw.integers(0, 3, (3, len(word)))
        lists.append(suffix_dedup._Classes.read({"a": word.tobytes(), "b": np.zeros(len(word), np.uint64).tobytes(), **{c: p.tobytes() for c, p in zip("cde", place, strict=True)}}))
        for w, at in zip(word.tolist(), place.T.tolist(), strict=True):
            plain.setdefault(w, set()).add(tuple(at))
    one, gone = lists[0], []
    for other in lists[1:]:
        one, lost = suffix_dedup.merge_classes(one, other)
        gone += zip(*(x.tolist() for x in lost), strict=True)
    assert list(zip(one.ids.tolist(), one.keys.tolist(), one.at.tolist(), strict=True)) == [min(plain[w]) for w in sorted(plain)]
    assert set(gone) == {p for places in plain.values() for p in places - {min(places)}}


def test_suffix_dedup_long_texts_in_parts(spark, monkeypatch):
    rows = [(1, "".join(random.Random(5).choice("abc ") for _ in range(3000)))]
    rows.append((2, rows[0][1][700:2500] + "tail"))
    monkeypatch.setattr(suffix_dedup, "PIECE", 900)
    texts = [t.encode() for _, t in rows]
    parts = list(suffix_dedup.pieces(texts, 100))
    windows = sorted((n, int(o) + k) for d, e, ns, os_ in parts for n, o, a, b in zip(ns, os_, [0, *e[:-1]], e, strict=True) for k in range(int(b - a) - 99))
    assert windows == sorted((i, p) for i, t in enumerate(texts) for p in range(len(t) - 99))


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"banana-bandana-banana" * 3, np.uint8)
    order = suffix_dedup.suffix_array(data, 64)
    raw = data.tobytes()
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    got = suffix_dedup.common_prefixes(data, order, np.array([0]), 100)
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert list(got[1:]) == [lcp(raw[a:], raw[b:]) for a, b in zip(order, order[1:], strict=False)]


def test_suffix_dedup_defined_cases(spark):
    got = suffix_dedup.suffix_dedup(frame(spark, [(1, None), (2, "y" * 99), (None, "q" * 100), (4, "q" * 100), (5, "q" * 100), (5, "q" * 100)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 100), (1, 0), (2, 0), (4, 0), (5, 100), (5, 100)]
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    assert suffix_dedup.suffix_dedup(frame(spark, [(1, None), (2, "short")])).agg(F.sum("n_removed")).first()[0] == 0


# --- SentencePiece


def test_codec_equals_the_library_and_round_trips():
    import sentencepiece

    model, codec, draw = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Codec.load(), random.Random(6)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "🙂", "!!", "0", "AB", "   "]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(800)] + ["", " ", "a" * 3000, " " * 100, "abc" * 700 + " x", "x" + " " * 33 + "y"]
    for t in texts:
        assert codec.encode(t) == model.encode(t) and codec.decode(codec.encode(t)) == t


def test_encode_and_decode_frames(spark):
    rows = corpus(7, 40)
    got = pieces.encode(frame(spark, rows))
    assert got.where("not round_trip").count() == 0 and got.count() == 40
    assert {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()} == {i: t or "" for i, t in rows}


# --- fingerprints


def test_fingerprints(spark):
    draw = random.Random(8)
    own = ["".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    rows = [(i, t) for i, t in corpus(8, 30) if t] + [(1000 + i, " ".join(draw.choice(own) for _ in range(draw.randint(20, 80)))) for i in range(120)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, rows), (0.01, 0.5)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        changed = t[: len(t) - k] + after[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.1


def test_fingerprints_defined_cases(spark):
    got = fingerprints.fingerprints(frame(spark, [(1, None), (1, None), (None, "abc")])).collect()
    assert len(got) == 3 and all(0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprints(frame(spark, [(1, "abc")])).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(empty(spark)).count() == 0


# --- learned scorers


def labelled_rows(n=900):
    """Clean prose, shouting and symbols (low quality), and texts with slurs, of which some are disguised."""
    draw, rows, labels = random.Random(9), [], []
    for i in range(n):
        words = [draw.choice(["stone", "river", "green", "valley", "walk", "under", "cloud", "tree", "house", "light"]) for _ in range(draw.randint(20, 90))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["grubbler", "snivvex"] if draw.random() < 0.7 else ["gru88l3r", "ѕnivvex"])
        text = " ".join(f"{w.upper()}!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("run,column,modulus,rest", [(toxicity.toxicity, 2, 4, 2), (quality.quality, 1, 5, 0)])
def test_scores_hold_on_rows_not_seen(spark, run, column, modulus, rest):
    rows, labels = labelled_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(frame(spark, rows + [(5000, None), (5001, "")]), known).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    truth = {x[0]: x[column] for x in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert run(empty(spark), known).count() == 0
    assert run(frame(spark, rows[:5]), known.limit(0)).count() == 5


def test_folding_and_exceptions():
    assert toxicity.fold("L0SER $tup1d ѕсum 2024 $5") == "loser stupid scum 2024 $5"
    lexicon = toxicity.Lexicon({"loser": 2.0}, {"grub": 1.0}, ("sore loser",))
    assert [h[0] for h in lexicon.hits("a loser, losers, grubbing")] == ["loser", "grub"]
    assert lexicon.hits("a sore loser") == []


def test_language_id(spark):
    draw = random.Random(10)
    parts = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "ei", "ü"], "fr": ["eau", "oi", "que", "é"]}
    rows = [(i, " ".join("".join(draw.choice(parts[g]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(2, 60))), g) for i in range(600) for g in [draw.choice(list(parts))]]
    docs = spark.createDataFrame(rows + [(9000, None, "en"), (9001, "12 !?", "en"), (9002, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert len(got) == 603 and all(got[k]["lang_pred"] == "und" for k in (9000, 9001, 9002))
    held = [(got[i]["lang_pred"], g) for i, _, g in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert language_id.language_id(docs.limit(0)).count() == 0
    none = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_model(spark):
    draw = random.Random(11)
    chain = {w: [WORDS[(i + 1) % 12], WORDS[(i + 2) % 12]] for i, w in enumerate(WORDS)}

    def walk(n):
        out = [draw.choice(WORDS)]
        while len(out) < n:
            out.append(draw.choice(chain[out[-1]]))
        return out

    rows = [(i, " ".join(walk(60))) for i in range(900)]
    shuffled = [(10_000 + i, " ".join(draw.sample(t.split(), 60))) for i, t in rows[:60]]
    got = {r["doc_id"]: r for r in lm_score.lm_score(frame(spark, rows + shuffled + [(1_000_000, None)])).collect()}
    assert got[1_000_000]["n_words"] == 0 and got[1_000_000]["log_likelihood"] == 0.0
    # A text against its own words in another order: the order alone must tell them apart.
    assert np.mean([got[i]["mean_log_likelihood"] > got[10_000 + i]["mean_log_likelihood"] for i in range(60)]) > 0.9
    assert all(r["log_likelihood"] == pytest.approx(r["mean_log_likelihood"] * r["n_words"]) for r in got.values())
    assert lm_score.lm_score(empty(spark)).count() == 0


def test_network_gradient():
    net, rng = lm_score.Network(1), np.random.default_rng(0)
    context, word = rng.integers(0, lm_score.WORDS, (64, 4)), rng.integers(0, lm_score.WORDS, 64)
    state = [np.zeros_like(x) for x in net.p]
    before = net.log_probability(context, word).mean()
    for _ in range(30):
        net.step(context, word, state)
    assert net.log_probability(context, word).mean() > before + 1.0


# --- all together


def test_pipeline_on_a_small_corpus(spark, monkeypatch):
    import corpus_pipeline

    rows, labels = labelled_rows(240)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    rows += [(1000 + i, t, g, s, n) for i, t, g, s, n in rows[:20]] + [(2000, None, None, None, None), (1, rows[1][1], "en", "s1", rows[1][4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))

    class Tables:
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: Tables.known)
    now, truth = docs, {x[0]: x[1] for x in labels}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.written(stage(spark, now, ""), corpus_pipeline.workdir(spark, "test-stage"))
        if k < 4:
            assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if k == 0:
            assert sum(truth[i] for i in ids if i in truth) >= 0.97 * sum(truth.values()) and all(truth.get(i, 1) or i >= 1000 for i in ids)
        if k == 1:
            assert len(ids) == len(set(ids)) and not any(1000 <= i < 1020 and i - 1000 in ids for i in ids)
        now = after
    assert now.where("not round_trip").count() == 0 and now.count() > 0


def test_registry():
    names = queries()
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
