"""Spelling variants against plain Python: counting, digests, the join at every depth of parting, forms and roots."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoweave.llm import spelling as S

RUN, LOWER = re.compile("[A-Za-zÀ-ÿ]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, noise=199, least=6, often=5):
    n = Counter()
    for i, text in rows:
        for w in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, times=5):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in words:
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= times * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_digests_are_crc32():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + np.concatenate([rng.integers(0, 70, 290), rng.integers(500, 1000, 10)])
    before = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]
    assert S.digests(data, starts, ends, before).tolist() == want
    assert S.digests(data, starts[:0], ends[:0], before[:0]).tolist() == []


@pytest.mark.parametrize("gathered", [1, 1 << 19])
def test_words_against_a_plain_count(spark, monkeypatch, gathered):
    monkeypatch.setattr(S, "GATHERED", gathered)
    rng = random.Random(2)
    words = ["Grüßen", "übermäßig", "naïvetés", "ÉCOLIERS", "écoliers", "plainword", "shorty", "abcde", "x÷y×zabc", "wörter", "z" * 90]
    rows = [(i % 40, " ".join(rng.choice(words) + rng.choice(["", "1", ".", "Ā", "ß", "\U0001f600"]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(None, "nothing nothing nothing nothing nothing nothing"), (3, None), (4, ""), (5, "q" * 100000 + " plainword" * 7), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n").repartition(3)
    for noise in (3, 199):
        assert {r.word: r.n for r in S.vocabulary(docs, noise=noise).collect()} == brute_words(rows, noise)


@pytest.mark.parametrize("worth", [0, 1, 24])
def test_pairs_at_every_depth(spark, worth):
    """Few letters, so that nearly all words share segments: parted until one letter is left (worth 0) or not at all."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([5, 6, 30, 150, 800]) for _ in range(260)}
    words |= {"common" + x + y: rng.randint(5, 99) for x in "abcdefgh" for y in "stuvwxyz"}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    got = S.near_pairs(table, worth=worth).collect()
    assert {(r.r, r.s) for r in got} == want and len(got) == len(want)
    assert all(words[r.r] == r.r_n and words[r.s] == r.s_n for r in got)
    assert rows_of(S.forms(table, worth=worth)) == brute_forms(words)


def test_a_large_group_is_parted_until_its_keys_are_small(spark, monkeypatch):
    """4,096 words with one common half: no key that is compared has more than its worth."""
    words = spark.range(4096).selectExpr("concat('common', substring(conv(id + 4096, 10, 8), 2, 4)) as word", "5L as n")
    most, kept = [], S.materialize

    def watched(df, tag):
        out = kept(df, tag)
        if tag == "spelling-entries":
            most.append(out.where("side = 0").groupBy("key").count().selectExpr("max(count)").first()[0])
        return out

    monkeypatch.setattr(S, "materialize", watched)
    assert S.near_pairs(words).count() == 4096 * 4 * 7 // 2  # each of four places has seven other figures
    assert most[0] == 4096 and len(most) > 2 and most[-1] <= 64


def test_roots_follow_long_chains(spark):
    words, w = {}, "aaaaaaaaaaaa"
    for k in range(12):
        words[w[:k] + "b" * k + w[2 * k :] if k < 6 else "b" * k + w[k:]] = 5 * 5**k
    words = {"b" * k + "a" * (12 - k): 5 * 5**k for k in range(12)}
    got = rows_of(S.forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_forms(words) and {r[2] for r in got} == {"bbbbbbbbbbba"}


def test_edge_documents(spark, edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    words = brute_words(rows, least=4, often=2)
    assert words and rows_of(S.variants(edge_docs, least=4, often=2)) == brute_forms(words)
    assert S.variants(empty_docs).collect() == []
