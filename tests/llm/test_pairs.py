"""Similarity operators against brute force: n-gram join, line dedup."""

import re

import pyarrow as pa
import pytest
from corpus_fixtures import words  # noqa: F401

from hearthlens.llm import line_dedup, ngram_join

BLANK = r"[\x20\x09-\x0D]+"


def shingles(words, k=5):
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def close(a, b, percent=80):
    i = len(a & b)
    return bool(a) and bool(b) and 100 * i >= percent * (len(a) + len(b) - i)


def edited(rng, words, n, make):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = make(1)[0]
    return out


def corpus(words):
    """Exact copies, a spread of near copies of few sources, shared passages."""
    rng, texts = words.rng, []
    for base in range(6):
        source = words(rng.randint(20, 90))
        texts += [" ".join(source)] * 3 + [" ".join(edited(rng, source, rng.randint(0, 5), words)) for _ in range(14)]
    passage = words(30)
    texts += [" ".join(words(rng.randint(1, 60)) + passage + words(rng.randint(1, 60))) for _ in range(12)]
    texts += ["", None, "  \t\n ", "One", "one", "ONE two", "one\ttwo", "é É", "x" * 50_000, " ".join(words(5000))]
    return texts


def brute_components(texts):
    sets = [shingles([w for w in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]) for t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if close(sets[i], sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("frequent", [64, 2])
def test_ngram_components_equal_brute_force(spark, words, frequent):
    texts = corpus(words)
    order = list(range(len(texts)))
    words.rng.shuffle(order)  # ids do not follow the copies
    texts = [texts[i] for i in order]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, rep string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, frequent=frequent).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_equal_sets_have_equal_fingerprints_wherever_they_stand():
    texts = ["a b c d e f g", "", "z", "a b c d e f g", "x y", "z"]
    for order in (texts, texts[::-1], texts[:4], [*texts, ""]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int64()), pa.array(order)], names=["doc_id", "text"])
        rows = next(ngram_join._profile(5)([batch])).to_pylist()
        marks = {}
        for t, r in zip(order, rows, strict=True):
            marks.setdefault(t, set()).add((r["n"], r["f1"], r["f2"]))
        assert all(len(m) == 1 for m in marks.values()) and len(set.union(*marks.values())) == len(marks)


def test_one_token_sets_link_through_frequent_tokens(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a"), (2, "a c")], "doc_id long, text string")
    got = ngram_join.ngram_components(df, k=1, percent=50, frequent=1).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_packing_query_keeps_near_copies_apart(spark, words, tmp_path):
    from hearthlens.llm import queries

    source = words(40)
    texts = [" ".join(source[:-1] + [f"end{i}"]) for i in range(12)] + [" ".join(words(40)) for _ in range(12)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, texts[20], "s30")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = {r["doc_id"]: r["bin_id"] for r in queries.op7_packing(spark, str(tmp_path)).collect()}
    assert set(bins) == {i for i, _, _ in rows}
    assert len({bins[i] for i in range(12)}) == 12 and len(set(bins.values())) == 12


def test_prefixes_hold_two_shared_tokens():
    for n in range(2, 200):
        for m in range(n, 200):
            if 100 * n >= 80 * m:
                need = -(-80 * (n + m) // 180)  # smallest overlap of a linked pair
                assert need >= 2 and n - ngram_join.prefix_length(n, 80, 2) <= need - 2 and m - ngram_join.prefix_length(m, 80, 2) <= need - 2


def test_ngram_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(empty).collect() == []
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)]
    got = sorted(tuple(r) for r in ngram_join.ngram_components(spark.createDataFrame(rows, empty.schema)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    kept = ngram_join.drop_near_copies(spark.createDataFrame([*rows, (3, "A b C")], empty.schema))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 1, 2] and kept.count() == 4


def brute_lines(texts):
    seen, gone = [], {}
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            s = shingles([w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w])
            if any(close(s, o) for o in seen):
                gone.setdefault(d, []).append(p)
            seen.append(s)
    return gone


def test_line_dedup_equals_brute_force(spark, words):
    lines, rng = [t.replace("\n", " ") for t in corpus(words) if t and len(t) < 5000], words.rng
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.7 else rng.choice(["", " ", " two  words ", "Two\twords", "solo"]) for _ in range(rng.randint(1, 8))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, line int").repartition(4)
    want = brute_lines(texts)
    rows = {r["doc_id"]: r for r in line_dedup.dedup_report(df).collect()}
    assert {d: r["removed"] for d, r in rows.items() if r["removed"]} == want
    assert all(rows[d]["n_lines"] == t.count("\n") + 1 for d, t in enumerate(texts) if t is not None) and 40 not in rows
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(d, []))
        if d in want and not left.strip():
            assert d not in kept
        else:
            assert kept[d] == left


def test_line_dedup_by_words_finds_edits_in_mid_line(spark, words):
    rng, lines = words.rng, []
    for _ in range(25):
        source = words(rng.randint(1, 40))
        lines += [source] + [edited(rng, source, rng.randint(1, 3), words) for _ in range(4)]
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(w) for w in lines[i : i + 5]) for i in range(0, len(lines), 5)] + ["", "  \n\t"]
    seen, want = [], set()
    for i, w in enumerate(lines):
        if any(close(set(w), o) for o in seen):
            want.add((i // 5, i % 5))
        seen.append(set(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], p) for r in line_dedup.dedup_report(df, shingle=1).collect() for p in r["removed"]}
    assert got == want and len(want) > len([p for r in line_dedup.dedup_report(df).collect() for p in r["removed"]])


def test_line_query_and_stage_join_on_words(spark, tmp_path):
    import corpus_pipeline
    from hearthlens.llm import queries

    a = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a, 62), (2, a.replace("six", "other"), 62)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (2, 1)]
    assert [r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, df, str(tmp_path)).collect()] == [1]


def test_line_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_report(empty).collect() == [] and line_dedup.drop_lines(empty).collect() == []
    rows = [(None, "a\na"), (5, "a\nb"), (5, "a\nb"), (5, "c\nb")]
    df = spark.createDataFrame(rows, empty.schema)
    assert [tuple(r) for r in line_dedup.dedup_report(df).collect()] == [(5, 4, 1, [1])]
    # the row without an id is left as it is, equal rows are one document, and
    # of the two texts of id 5 the one with the smaller hash comes first
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in line_dedup.drop_lines(df).collect())
    assert got in ([(0, "a\na"), (5, "a\nb"), (5, "a\nb"), (5, "c")], [(0, "a\na"), (5, "a"), (5, "a"), (5, "c\nb")])
