"""Token alignment: sparse products against dense ones, the digest against a plain re-computation."""

import collections
import hashlib
import json

import numpy as np
import pytest
from corpus_fixtures import words  # noqa: F401

from hearthlens.llm import token_alignment as ta


@pytest.fixture(scope="module")
def tokenizers():
    return ta.ByteBpe(open(ta.A_PATH, "rb").read()), ta.PieceBpe(open(ta.B_PATH, "rb").read())


def test_row_products_equal_dense_products():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m, k, n = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 2, (m, k)), rng.integers(0, 2, (k, n))
        csr = [ta.Csr(np.concatenate([[0], d.sum(1).cumsum()]), np.nonzero(d)[1], d.shape[1]) for d in (x, y)]
        for block in (1, 5, 1000):
            got = np.zeros((m, n), dtype=int)
            for i, j, v in ta.row_products(*csr, block=block):
                got[i, j] += v
            assert (got == x @ y).all()
        t = csr[0].transposed()
        assert [t.idx[t.ptr[r]:t.ptr[r + 1]].tolist() for r in range(k)] == [np.flatnonzero(x[:, r]).tolist() for r in range(k)]


TEXTS = ["plain words here", "", None, " two  spaces\n\n\ttabs ", "<|endoftext|> and <s></s> <unk>", "▁ is a piece mark", "é😀漢字 ñandú", "a" * 5000, " " * 700, "0x41<0x41> 'll I'm don't 12345",
         "\x00\x07 control", "word " * 9000, "x", "   nbsp"]


def test_byte_bpe_gives_the_files_own_tokens(tokenizers, words):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(ta.A_PATH)
    plain.encode_special_tokens = True
    texts = [t for t in TEXTS if t] + [" ".join(words(200)) for _ in range(20)]
    assert tokenizers[0].encode(texts) == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]


def letters():
    """Byte of each letter, read off the JSON's own single-letter entries by their order."""
    vocab = json.load(open(ta.A_PATH))["model"]["vocab"]
    return {k: ta.byte_letters()[k] for k in vocab if len(k) == 1}


def plain_alignment(text, tokenizers):
    """Token by token: (A ids, B ids, links as positions, groups) or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    tok = Tokenizer.from_file(ta.A_PATH) if not hasattr(plain_alignment, "tok") else plain_alignment.tok
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=ta.B_PATH) if not hasattr(plain_alignment, "sp") else plain_alignment.sp
    plain_alignment.tok, plain_alignment.sp = tok, sp
    of = letters()
    e = tok.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(of[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None

    def spans(tokens):
        at = 0
        for i, x in tokens:
            yield i, at, at + len(x)
            at += len(x)

    sa, sb = list(spans(a)), list(spans(b))
    owner = [j for j, (_, s, t) in enumerate(sb) for _ in range(s, t)]
    links = [(k, j) for k, (_, s, t) in enumerate(sa) for j in sorted(set(owner[s:t]))]
    cuts = sorted({t for *_, t in sa} & {t for *_, t in sb})
    groups, at = [], 0
    for c in cuts:
        groups.append(([i for i, s, t in sa if at <= s and t <= c], [i for i, s, t in sb if at <= s and t <= c]))
        at = c
    return [i for i, *_ in sa], [i for i, *_ in sb], links, groups


def brute(docs, tokenizers):
    seen = [plain_alignment(t, tokenizers) for _, t in docs]
    count = collections.Counter((x[0][i], x[1][j]) for x in seen if x for i, j in x[2])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = collections.Counter()
    for (doc, _), x in zip(docs, seen):
        if x is None:
            out[(doc, 0, 0, 0, 0, 0, 0, "", 0)] += 1
            continue
        ids = [(x[0][i], x[1][j]) for i, j in x[2]]
        s = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in x[3])
        out[(doc, len(x[0]), len(x[1]), len(x[3]), len(ids), sum(count[p] == best[p[1]] for p in ids), sum(count[p] for p in ids), hashlib.sha256(s.encode()).hexdigest(),
             sum(len(g[0]) * len(g[1]) for g in x[3]))] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 3000, ta.CHUNK])
def test_digest_against_brute_force(spark, words, tokenizers, chunk):
    texts = [t if t is None or len(t) < 2000 else t[:900] for t in TEXTS] + [" ".join(words(words.rng.randint(1, 60))).title() for _ in range(25)]
    docs = [*enumerate(texts), (3, texts[3]), (None, texts[0]), (None, None), *((100 + i, texts[-1]) for i in range(20))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, chunk int, pair int").repartition(3)
    got = collections.Counter(tuple(r) for r in ta.alignment_digest(df, chunk=chunk).collect())
    assert got == brute(docs, tokenizers)


def test_very_long_text_in_blocks(tokenizers, words):
    text = " ".join(words(150_000)) + "z" * 3000
    al = ta.Alignment([None, text, "b"], *tokenizers)
    n = sum(len(i) for i, *_ in al.overlap_links())
    assert n == sum(al.n_tokens[0]) + sum(al.n_tokens[1]) - al.n_groups_all  # two cuts of one line overlap in a staircase
    assert sum(v.sum() for *_, v in al.overlap_links()) == len(text) + 1 + 2  # every byte is shared once
    assert al.n_group_links().sum() == sum(len(i) for i, *_ in al.group_links())


def test_links_are_real_spans(spark, tokenizers):
    rows = ta.token_links(spark.createDataFrame([(1, "don't stop"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    raw = b" don't stop"
    a, b = ([raw[s:t] for s, t in zip([0, *e], e)] for e in (rows[0]["a_ends"], rows[0]["b_ends"]))
    assert a == [tokenizers[0].bytes_of[i] for i in rows[0]["a_ids"]] and b == [tokenizers[1].bytes_of[i] for i in rows[0]["b_ids"]]
    assert sum(x["bytes"] for x in rows[0]["links"]) == len(raw) and rows[0]["group_ends"][-1] == len(raw)
    assert rows[1]["a_ids"] == [] and rows[1]["links"] == []


def test_empty_table(spark):
    assert ta.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
