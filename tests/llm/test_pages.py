"""WARC archives, URL filters, packing: round trips, brute force, edges."""

import base64
import collections
import glob
import hashlib
import re

import pytest
from corpus_fixtures import words  # noqa: F401
from pyspark.sql import functions as F

from hearthlens.llm import packing, url_filter, warc


def test_base32_sha1(spark):
    df = spark.createDataFrame([("",), ("a",), ("é😀" * 1000,)], "t string")
    got = [r[0] for r in df.select(warc.base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(r["t"].encode()).digest()).decode() for r in df.collect()]


PAGES = [(1, "http://a/é x\r\ny", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\nWARC-Type: response\r\n\r\nfake\r\n\r\n"),
         (6, "", "\r\n\r\n\r\n"), (6, "", "\r\n\r\n\r\n"), (None, "u", "<p>ü</p>"), (7, "http://e", "z" * 300_000), (None, "v", "alone")]


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_warc_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int").repartition(3)
    got = collections.Counter(tuple(r) for r in warc.round_trip(df, min_bytes=min_bytes).collect())
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(i, first.get(b, i))
    n = collections.Counter((h or "").encode() for _, _, h in PAGES)
    want = collections.Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = n[b] > 1 and b in first and i != first[b]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None)] += 1
    assert got == want


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_pushdown_and_payload_skipping(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(warc.mark_revisits(df), path, compression=compression)
    if compression == "none":  # plain WARC: every record starts with the version and ends with two line ends
        raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    heads = warc.read_warc(spark, path, ["record_type", "record_id", "target_uri"])
    one = heads.where("record_type = 'revisit' and record_id in ('<urn:x-page:2>', '<urn:x-page:4>')")
    assert sorted(r["record_id"] for r in one.collect()) == ["<urn:x-page:2>", "<urn:x-page:4>"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # the source takes the predicates
    assert heads.where("record_id = '<urn:x-page:1>'").first()["target_uri"] == "http://a/é%20x%0A%0Ay"
    body = warc.read_warc(spark, path).where("record_id = '<urn:x-page:5>'").first()
    assert bytes(body["payload"]).decode() == PAGES[4][2] and body["content_length"] > len(PAGES[4][2])


def test_warc_reader_steps_over_payloads(tmp_path):
    """The reader seeks past blocks that it does not want."""
    import io

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    reader = warc.WarcReader(["record_type"], {"path": "x"})
    assert list(reader._records(io.BytesIO(record * 2))) == [({"warc-type": "response", "content-length": "5"}, None)] * 2
    reader.tests = [("warc-type", frozenset(["revisit"]))]
    assert list(reader._records(io.BytesIO(record))) == []
    with pytest.raises(ValueError, match="no WARC record"):
        list(reader._records(io.BytesIO(b"junk\r\n")))


def test_warc_plans_small_files_together(tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}").write_bytes(b"x" * 40)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    parts = warc.WarcReader(["record_type"], {"path": str(tmp_path), "partition_bytes": "100"}).partitions()
    assert [len(p.files) for p in parts] == [2, 2, 1]


def test_warc_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def split_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules):
    fits = [(v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1])) if fits else (None, None)


def test_url_filter_follows_rules_and_classifier(spark):
    urls = [None, "", "no scheme", "://", "HTTP://WWW.Example.NET/en/a?b#c", "http://example.net/EN/", "http://x.net", "http://x.net?y/", "http://net/", "http://a.org/fr/1", "http://a.org/frx",
            "http://b.example.com/de/", "http://example.com/de", "x://ÄB.com/ü", "a://b://c/d", "http://notexample.net/en/", "https://ads-track.casino.com/banner", "https://news.library.com/history", "http://h/" + "p" * 20_000, "line\nhttp://k.net/a\nb"]
    urls += urls[:3]
    model = url_filter.UrlClassifier.fit(url_filter.labelled_urls(spark))
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge(df, model, url_filter.RULES).collect()}
    for i, u in enumerate(urls):
        host, path = split_url(u)
        verdict, rule = rule_of(host, path, url_filter.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["p_block"] >= 0.5 else "allow")) and 0 <= got[i]["p_block"] <= 1
    by = {u: got[i]["verdict"] for i, u in enumerate(urls)}
    assert by["https://ads-track.casino.com/banner"] == "block" and by["https://news.library.com/history"] == "allow"
    assert url_filter.judge(df.limit(0), model, url_filter.RULES).collect() == []


def test_url_classifier_scores_equal_its_weights(spark):
    """Held-out labelled URLs, and the column expression against Python."""
    t = url_filter.labelled_urls(spark).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(4)))
    model = url_filter.UrlClassifier.fit(t.where("part > 0"))
    rows = t.where("part = 0").select("label", "url", *[c.alias(n) for c, n in zip(url_filter.split_url(F.col("url")), ("host", "path"))])
    got = rows.select("label", url_filter.features(F.col("host"), F.col("path"), model.dim).alias("ids"), model.prob(F.col("host"), F.col("path")).alias("p")).collect()
    assert sum((r["p"] >= 0.5) == (r["label"] == 1) for r in got) >= 0.8 * len(got)
    import math
    for r in got[:20]:
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(model.weights[i] for i in r["ids"])))))


def naive_best_fit(items, capacity):
    bins, out = [], []
    for length, s, c in items:
        fits = [(capacity - sum(x[0] for x in b) - length, k) for k, b in enumerate(bins)
                if sum(x[0] for x in b) + length <= capacity and all((s is None or x[1] != s) and (c is None or x[2] != c) for x in b)]
        if not fits:
            bins.append([])
            fits = [(0, len(bins) - 1)]
        k = min(fits)[1]
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((length, s, c))
    return out


def test_best_fit_equals_naive_search(words):
    rng = words.rng
    for _ in range(30):
        items = [(rng.randint(1, 60), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(30)])) for _ in range(150)]
        assert packing.best_fit(items, 100) == naive_best_fit(items, 100)


@pytest.mark.parametrize("shard_pieces", [4096, 10])
def test_packing_keeps_its_promises(spark, words, shard_pieces):
    rng = words.rng
    docs = [(i, " ".join(words(rng.choice([0, 1, 5, 30, 99, 100, 101, 350]))), rng.choice(["hot", "hot", "a", "b", None])) for i in range(120)]
    docs += [(200, None, "a"), (None, "one two", "a"), (None, "one two", "a"), (201, "same text here", "x"), (202, "same text here", "y"), (203, "same text here", None)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, copy int, length int").repartition(4)
    got = packing.pack_documents(df, capacity=100, shard_pieces=shard_pieces).collect()
    source = {d: s for d, _, s in docs}
    text = {d: t for d, t, _ in docs}
    per = collections.defaultdict(list)
    for r in got:
        per[(r["doc_id"], r["copy"])].append(r)
    assert len(per) == len(docs) and {(None, 0), (None, 1)} <= set(per)
    for (d, _), rows in per.items():
        n = len((text[d] or "").split())
        assert sum(r["length"] for r in rows) == n and sorted(r["piece"] for r in rows) == list(range(max(1, -(-n // 100))))
        assert all((r["bin_id"] is None) == (r["length"] == 0) for r in rows)
    bins = collections.defaultdict(list)
    for r in got:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 100
        named = [source[r["doc_id"]] for r in rows if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
        assert len({text[r["doc_id"]] for r in rows}) == len(rows)
    assert packing.pack_documents(df.limit(0)).collect() == []
