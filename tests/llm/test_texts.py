"""Scores, fingerprints, language, licences, passages: brute force and edges."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from corpus_fixtures import words  # noqa: F401
from pyspark.sql import functions as F

from hearthlens.llm import codepoints, decontam, language, license_scan, lm_score, spotsigs

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_lm(texts, order, backoff=0.4):
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] for t in texts]
    own = [collections.Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in docs]
    total = sum(own, collections.Counter())
    n = sum(map(len, docs))
    out = []
    for w, o in zip(docs, own):
        score = 0.0
        for i in range(len(w)):
            k = min(order, i + 1)
            while k > 1 and total[g := tuple(w[i - k + 1:i + 1])] == o[g]:
                score += math.log(backoff)
                k -= 1
            g = tuple(w[i - k + 1:i + 1])
            f = total[g] - o[g]
            score += math.log(f / (total[g[:-1]] - o[g[:-1]])) if k > 1 else math.log((f or 0.5) / max(n - len(w), 1))
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [200, 10**7])
def test_lm_scores_equal_brute_force(spark, words, order, block_bytes):
    texts = [" ".join(words(words.rng.randint(1, 40))) for _ in range(40)] + ["", None, " \t", "Zebra zebra", "zebra"]
    texts += texts[:5]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm_score.score(df, order=order, block_bytes=block_bytes).collect()}
    for i, (n, s) in enumerate(brute_lm(texts, order)):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_lm_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(empty).collect() == []
    got = lm_score.score(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], empty.schema)).collect()
    assert sorted((r["n_words"], r["mean_log_score"]) for r in got if r["n_words"]) == [(1, 0.0), (1, 0.0)] and len(got) == 3


def test_fingerprints_follow_the_next_document(spark, words):
    ids = [0, 1, 2, 5, 1023, 1024, 5000, 5_000_000, -7]
    texts = ["the cat sat on the mat and the dog ran to the house by the sea", "", None, "Ünïcode 😀 der Hund und die Katze", "x", "a b c d e f g h", " ".join(words(3000)), "the " * 50, "the cat sat on the mat and the dog ran to the house by the sea"]
    df = spark.createDataFrame([(i, t, "b") for i, t in zip(ids, texts)], "doc_id long, text string, bucket string").repartition(4)
    got = {r["doc_id"]: r for r in spotsigs.compare_with_edits(df).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - c] + nxt[:c]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_next"] == 1.0 or got[i]["fingerprint"] != got[order[(k + 1) % len(order)][0]]["fingerprint"]
    assert got[0]["fingerprint"] == got[-7]["fingerprint"] != "" and got[0]["near_next"] == 1.0
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == ""


def _members(fingerprint):
    return {fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)}


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likenesses_are_those_of_the_fingerprints(spark, words):
    rng = random.Random(11)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)] + [-5, 0, 1]
    texts = [" ".join(rng.choice(["the", "of", "und"]) if rng.random() < 0.3 else w for w in words(rng.randrange(1, 90))) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in spotsigs.compare_with_edits(df).collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        own, nxt = _members(got[i]["fingerprint"]), _members(got[order[(k + 1) % len(order)]]["fingerprint"])
        assert own and got[i]["near_edited"] == pytest.approx(_likeness(own, _members(got[i]["edited_fingerprint"])))
        assert got[i]["near_next"] == pytest.approx(_likeness(own, nxt))
    alone = {r["doc_id"]: r["fingerprint"] for i, t in list(zip(ids, texts))[:5] for r in spotsigs.compare_with_edits(spark.createDataFrame([(i, t)], "doc_id long, text string")).collect()}
    assert all(got[i]["fingerprint"] == f for i, f in alone.items())


@pytest.mark.parametrize("most", [100_000, 3, 2])
def test_next_key_at_any_number_of_levels(spark, most):
    rng = random.Random(4)
    keys = sorted({rng.randrange(-(1 << 53), 1 << 53) for _ in range(40)} | {0, 1, 2, 1023, 1024, -1}, reverse=True)
    got = {r["bucket"]: r["after"] for r in spotsigs._next_key(spark.createDataFrame([(k,) for k in keys], "bucket long"), most).collect()}
    assert got == {k: keys[(i + 1) % len(keys)] for i, k in enumerate(keys)}


@pytest.mark.parametrize("spots", [0, 2, 7, 8, 9, 30])
def test_one_changed_word_moves_the_likeness_a_little(spark, words, spots):
    """The same rule with few and many anchors."""
    w = words(80 + 2 * spots)
    for i in range(spots):
        w.insert(3 * i + 1, "the")
    rows = []
    for i in range(0, len(w), 7):
        rows.append((" ".join(w), " ".join([*w[:i], "zzzq", *w[i + 1 :]])))
    df = spark.createDataFrame(rows, "a string, b string")
    df = spotsigs.with_signatures(spotsigs.with_signatures(df, "a", "x"), "b", "y")
    got = [r[0] for r in df.select(spotsigs.jaccard(F.col("x"), F.col("y"))).collect()]
    assert min(got) >= 0.6 and sum(got) / len(got) >= 0.85


def test_fingerprint_chains_and_pruning(spark):
    df = spark.createDataFrame([("the old man and the sea is deep",)], "t string")
    got = df.select(F.regexp_extract_all("t", F.lit(spotsigs.spot_pattern(2)), F.lit(1)).alias("s")).first()["s"]
    assert got == ["the old man", "and the sea is deep", "the sea is deep"]
    pairs = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], list(range(100))), ([1], [])], "a array<int>, b array<int>")
    assert [r[0] for r in pairs.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"), 0.05)).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string"
    assert spotsigs.compare_with_edits(spark.createDataFrame([], schema)).collect() == []
    got = spotsigs.compare_with_edits(spark.createDataFrame([(None, "the old man"), (3, "q"), (3, "q")], schema)).collect()
    assert len(got) == 3 and all(r["near_next"] == 1.0 for r in got)


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.LanguageModel.fit(docs.where(~language.held_out(F.col("doc_id"))))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = [(1, None), (2, ""), (3, "123 !? 😀"), (4, "the house and the garden of the king"), (4, "the house and the garden of the king"), (None, "éréier enqueeau de les la vioi menteux èmentier répa que éréoi queoi"), (5, "THE HOUSE AND THE " * 20_000)]
    df = spark.createDataFrame([(*r, "z", 1.0) for r in odd], "doc_id long, text string, key string, score double")
    out = {}
    for r in language.identify(df, model).collect():
        assert 0 <= r["score"] <= 1 and out.setdefault(r["doc_id"], (r["lang_pred"], r["score"])) == (r["lang_pred"], r["score"])
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == out[5][0] == "en" and out[None][0] == "fr"
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 4, 5]
    none = language.LanguageModel.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []


def test_a_text_is_judged_alone(spark):
    """The prediction does not depend on the texts around it."""
    ids, ok, starts, _ = language._grams(["ab, c", "Zürich"])
    one = [language._grams([t]) for t in ("ab, c", "Zürich")]
    for d, (i1, o1, s1, _) in enumerate(one):
        for k in range(3):
            a, b = starts[d], min(starts[d + 1], len(ids[k]))
            assert list(ids[k][a:b][ok[k][a:b]]) == list(i1[k][o1[k]])


def test_temperature_and_ftrl():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    rows = [(np.array([c, 3 + int(rng.integers(0, 5))]), np.array([1.0, 1.0]), int(c)) for c in y]
    w = language.ftrl(rows, 3, 10)
    scores = np.array([x @ w[i] for i, x, _ in rows])
    assert (scores.argmax(1) == y).all() and (np.abs(w) == 0).any()  # the penalty leaves zeros
    noisy = np.where(rng.random(400) < 0.7, y, rng.integers(0, 3, 400))
    z = np.eye(3)[noisy] * 8
    t = language.temperature(z, y)
    loss = lambda t: float((np.log(np.exp(z / t).sum(1)) - (z / t)[np.arange(400), y]).mean())
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.1, 15, 200)) + 1e-4


def test_folding_matches_python():
    texts = ["Hello,  World!", "ÀÉ\n\nß 12", "", "😀a𝒳b"]
    f, at, starts = codepoints.points(texts, True, 1)
    for d, t in enumerate(texts):
        s = "".join(chr(c) if c else " " for c in f[starts[d]:starts[d + 1]])
        assert s.split() == re.sub(r"[^\w]|_", " ", t).lower().split()


def edit_distance_in(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment_equals_full(words):
    rng = words.rng
    for _ in range(60):
        p = [rng.randint(1, 4) for _ in range(rng.randint(5, 25))]
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        cost, s, e = decontam.banded_distance(np.array(p), np.array(t, dtype=np.int64), 0, 80)
        assert cost == edit_distance_in(p, t) and 0 <= s <= e <= len(t)


def test_passages_with_edits_are_found_and_clean_texts_left(spark, words):
    rng = words.rng
    items = [(i, " ".join(words(rng.randint(20, 45)))) for i in range(25)]
    docs, want = [], {}
    for d in range(60):
        text = " ".join(words(rng.randint(0, 200)))
        if d % 2:
            i, p = items[rng.randrange(25)]
            e = rng.randint(0, decontam.budget(len(p), 10, 0.08) // 2)
            s = list(p)
            for _ in range(e):
                j = rng.randrange(len(s))
                if s[j] != " ":
                    s[j] = rng.choice("qrstuvwxyz")
            where = len(text)
            text = f"{text}, {''.join(s).upper() if d % 3 else ''.join(s).replace(' ', '  ')}! " + " ".join(words(50))
            want[d] = (i, where)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1])]
    want[102] = (1, None)
    df = spark.createDataFrame([(*r, 1, "e") for r in docs], "doc_id long, text string, item long, bad string").repartition(3)
    bench = spark.createDataFrame([*items, (90, None), (91, "short"), (None, "no id here at all"), items[3]], "item_id long, text string")
    for block_chars in (4_000_000, 500):
        got = decontam.find_passages(df, bench, block_chars=block_chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d, (i, _) in want.items()}
        for r in got:
            text = dict(x for x in docs if x[0] is not None)[r["doc_id"]]
            found = re.sub(r"[^a-z0-9]+", " ", text[r["start"]:r["end"]].lower()).strip()
            assert edit_distance_in(dict(items)[r["item_id"]], found) <= 2 * r["edits"] + 2
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in clean.collect()) == sorted([d for d, _ in docs if d not in want and d is not None] + [-1])
    assert decontam.find_passages(df.limit(0), bench).collect() == [] and decontam.find_passages(df, bench.limit(0)).collect() == []


def test_pipeline_stage_judges_each_row_by_its_own_text(spark, words, tmp_path):
    import corpus_pipeline

    items = [(i, " ".join(words(30))) for i in range(4)]
    rows = [(None, "pre " + items[0][1]), (None, "clean"), (1, items[1][1] + " post"), (1, "clean too"), (2, None), (3, ""), (4, items[3][1].upper())]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, lang string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(None, "clean", "e"), (1, "clean too", "e"), (2, None, "e"), (3, "", "e")}
    assert {tuple(r) for r in corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect()} == want
    got = decontam.keep_clean(df, bench, block_chars=200)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == want


def test_licence_sample_takes_different_paragraphs(spark):
    lines = [f"prose number {i}" for i in range(60)]
    df = spark.createDataFrame([("\n".join(lines + lines[:30] * 40),)] * 3, "text string")
    table = license_scan.training_table(spark, df, "text", 50).where("family = 'none' and paragraph like 'prose number%'")
    got = [r["paragraph"] for r in table.collect()]
    assert len(got) == len(set(got)) == 50


def test_licences_are_named_and_lookalikes_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.LicenseClassifier.fit(spark, docs, sample=300)
    texts = {1: "Some prose here.\nReleased under the MIT License.\nMore prose.", 2: "Licensed under CC BY-NC 4.0.", 3: "He renewed his driving license last year.",
             4: None, 5: "", 6: "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", 7: "word " * 30_000}
    df = spark.createDataFrame([(i, t, "w", "p") for i, t in texts.items()] + [(None, "Released under the MIT License.", "w", "p")] * 2, "doc_id long, text string, w string, family string")
    got = {r["doc_id"]: r for r in license_scan.scan(df, model).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: ["mit"], 2: ["cc-by-nc"], 3: [], 4: [], 5: [], 6: ["apache-2.0", "gpl"], 7: [], None: ["mit"]}
    assert got[1]["n_paragraphs"] == 3 and got[4]["n_paragraphs"] == 0 and got[5]["n_paragraphs"] == 1 and got[None]["n_paragraphs"] == 2
    assert license_scan.scan(df.limit(0), model).collect() == []
    # every line of the corpus that names a licence, and no other
    notice = F.col("line").rlike("(?i)licen[sc]e|all rights reserved")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    found = license_scan.scan_paragraphs(docs, model).where("family not in ('none', 'unknown') and confirmed")
    assert {(r[0], r[1]) for r in lines.where(notice).select("doc_id", "paragraph").collect()} == {(r[0], r[1]) for r in found.select("doc_id", "paragraph").collect()}


def _passages(index, texts):
    """What is found in each text of one run."""
    out = [[] for _ in texts]
    for d, *rest in decontam.find_in_run(index, texts):
        out[d].append(tuple(rest))
    return [sorted(x) for x in out]


def test_a_text_gives_the_same_passages_beside_any_others(words):
    rng = words.rng
    items = [(i, " ".join(words(rng.randint(8, 45)))) for i in range(12)]
    index = decontam.QgramIndex(items, 10, 0.08)

    def edited(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 20))):
            at = rng.randrange(len(t))
            t[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        return "".join(t)

    texts = []
    for _ in range(150):
        _, item = rng.choice(items)
        texts.append(rng.choice([
            lambda: " ".join(words(rng.randint(0, 30))),
            lambda: " ".join(words(5)) + " " + edited(item) + " " + " ".join(words(5)),
            lambda: edited(item),
            lambda: " ".join(words(3)) + " " + item[:rng.randint(8, 14)],  # the text ends as a passage begins
            lambda: item[-rng.randint(8, 30):] + " " + " ".join(words(3)),
        ])())
    alone = [_passages(index, [t])[0] for t in texts]
    assert sum(map(bool, alone)) > 30
    for _ in range(8):
        order = rng.sample(range(len(texts)), len(texts))
        assert _passages(index, [texts[i] for i in order]) == [alone[i] for i in order]


def test_the_start_of_an_item_at_the_end_of_the_text_before(words):
    item = " ".join(words(40))
    index = decontam.QgramIndex([(1, item)], 10, 0.08)
    found = _passages(index, ["some text " + item[:10], "before " + item + " after"])
    assert found[0] == [] and [x[0] for x in found[1]] == [0]
