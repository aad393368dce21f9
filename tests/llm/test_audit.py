"""Filter audit: min-plus ranks, and the whole report against row-by-row runs of every order."""

import re
from itertools import permutations

import numpy as np
from corpus_fixtures import words  # noqa: F401

from hearthlens.llm import filter_audit


def test_min_plus_is_first_failing_step():
    orders = filter_audit.all_orders(4)
    assert len(orders) == 24
    masks = np.arange(16)
    got = filter_audit.removal_steps(masks, orders)
    for m in masks:
        for o, order in enumerate(orders):
            want = next((s for s, f in enumerate(order, 1) if m >> f & 1), filter_audit.NEVER)
            assert got[m, o] == want


def brute(docs, labels):
    """Applies every order to the list of rows, one filter at a time."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        rows.append((s or "", {k for k in bad if bad[k]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in mine if f in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def frames(spark, docs, labels, parts=3):
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, source string, mask int, w string").repartition(parts)
    return d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, h string")


def test_audit_against_row_by_row_runs(spark, words):
    docs, rng = [], words.rng
    for i in range(120):
        t = " ".join(words(rng.choice([3, 49, 50, 51, 120])))
        if rng.random() < 0.3:
            t = " ".join([*t.split()[:4]] * 20)
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.2:
            t += rng.choice("#$%&*|")
        docs.append((i, t, rng.choice(["web", "web", "books", None, ""])))
    docs += [(1000 + i, docs[7][1], "web") for i in range(60)]  # copies of one text
    docs += [(7, docs[7][1], "books"), (7, docs[7][1], "web"), (1005, docs[9][1], "web")]  # repeated ids
    docs += [(None, docs[7][1], "web"), (None, "only here", "books"), (2000, None, "nulls"), (2001, "", "nulls"), (2002, " \t\n", "nulls"), (1999, "x y " * 40_000, "long"), (None, None, None)]
    docs += [(3000, "é" * 95 + "A" * 5 + " a", "edge"), (3001, " ".join("abc") + "\x0b|", "edge")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1060, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None), (99_999, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    d, lab = frames(spark, docs, labels)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
           for r in filter_audit.audit_documents(d, lab).collect()}
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({s or "" for *_, s in docs})


def test_audit_of_empty_tables(spark):
    d, lab = frames(spark, [], [])
    assert filter_audit.audit_documents(d, lab).collect() == []
    d, _ = frames(spark, [(1, "a", "s")], [])
    rows = filter_audit.audit_documents(d, lab).where("step = 1").collect()
    assert {(r["filter_order"][0], r["removed"], r["good_lost"]) for r in rows} == {("A", 1, 0), ("B", 0, 0), ("C", 0, 0), ("D", 0, 0), ("E", 0, 0)}


def test_counts_of_one_cell_are_added_up(spark):
    cells = spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 1, 3, 0, 1), ("p", 0, 5, 5, 5)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.audit(cells, "AB").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows] == [
        ("AB", 1, 5, 5, 1, 1, 10), ("AB", 2, 5, 0, 0, 0, 0), ("BA", 1, 10, 0, 0, 0, 0), ("BA", 2, 5, 5, 1, 1, 10)]
    assert rows[0]["unique_fails"] == 5
