"""Each operator against a brute-force version, on rows with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import components, decontaminate, html_text, jaccard_join, lm, mixing, quality, telephony, toxicity, training_order, warc


def words(text):
    return (text or "").encode().lower().split()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- 1


def test_lm_base_is_the_unigram_and_scores_fall_with_noise(edge_docs, empty_docs):
    got = lm.score(edge_docs).collect()
    docs = edge_docs.select("doc_id", "text").collect()
    assert len(got) == len(docs)
    remainder = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    count = Counter()
    for r in docs:
        if remainder(r.doc_id) != 2:
            count.update([*words(r.text), None])
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(words(r.text)) + 1, sum(w in count for w in [*words(r.text), None]), remainder(r.doc_id) == 2, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(r.text), None]), 6)) for r in docs)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in got)
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(empty_docs).count() == 0


def test_lm_gives_equal_texts_equal_scores(edge_docs):
    same = defaultdict(set)
    text = {(r.doc_id): r.text for r in edge_docs.collect() if r.doc_id not in (107,)}
    for r in lm.score(edge_docs).collect():
        if r.doc_id in text and r.doc_id is not None:
            same[tuple(words(text[r.doc_id]))].add(round(r.score, 6))
    assert all(len(x) == 1 for x in same.values())


def spelling_texts(words, book):
    """Texts of one word each, every byte spelt from states that a hash of context and node picks."""
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    symbols = lm.pairs(data, ends)
    byte, node, bit = lm.decisions(symbols, book)
    texts = lm.Texts.__new__(lm.Texts)
    texts.block = lm.Block.__new__(lm.Block)
    n = len(words)
    texts.block.word, texts.block.first, texts.block.ends, texts.block.folds = np.arange(n), np.arange(n + 1), ends, np.zeros(n, np.uint8)
    texts.bit, texts.start = bit, np.concatenate([[0], np.cumsum(book[0][symbols])])[ends]
    texts.state = np.stack([((c[byte] >> np.uint64(40)) * np.uint64(31) + node * np.uint64(7) & np.uint64(255)).astype(np.uint8) for c in lm.contexts(data, ends, 64)])
    texts.listing = texts.naming = np.zeros(n, np.uint8)
    return texts


def test_lm_probabilities_sum_to_one():
    some = np.frombuffer(b"some text to count\n", np.uint8)
    book = lm.code(np.bincount(lm.pairs(some, np.array([0, len(some)])), minlength=1 << 16))
    assert np.allclose((2.0 ** -book[0].astype(float)).reshape(256, 256).sum(1), 1)
    rng = np.random.default_rng(1)
    odds = rng.integers(-60, 60, (lm.K, 256)).astype(np.int8)
    refine = lm.refinement(rng.integers(0, 50, (lm.GATES * lm.REFINE, 2)).astype(float))
    # all continuations of one byte after a fixed start
    bits = lambda words: lm.Mixer(spelling_texts(words, book), odds, lm.start_weights(), refine, 0.02).bits()
    whole, start = bits([b"ka" + bytes([c]) for c in range(256)]), bits([b"ka"])
    assert abs(sum(2.0 ** -(whole - start[0])) - 1) < 1e-4


def test_lm_steps_follow_the_text():
    """A text of one word over and over costs less and less, and no other text beside it changes that."""
    book = lm.code(np.zeros(1 << 16, np.int64))
    rng = np.random.default_rng(2)
    odds, refine = rng.integers(-20, 20, (lm.K, 256)).astype(np.int8), lm.refinement(np.zeros((lm.GATES * lm.REFINE, 2)))

    def bits(word, first):
        texts = spelling_texts([b"kaban ", b"lodor "], book)
        texts.block.word, texts.block.first, texts.block.folds = np.array(word), np.array(first), np.zeros(len(first) - 1, np.uint8)
        texts.listing = texts.naming = np.zeros(len(word), np.uint8)
        return lm.Mixer(texts, odds, lm.start_weights(), refine, 0.02).bits()

    short, long = bits([0] * 16, [0, 16])[0], bits([0] * 400, [0, 400])[0]
    assert long / 400 < short / 16
    both = bits([0] * 400 + [1] * 90, [0, 400, 490])
    assert abs(both[0] - long) < 1e-6 * long


def test_lm_names_followers_within_their_share():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        count = rng.zipf(1.5, n) + 1
        cost = lm.naming(count, np.full(n, count.sum()))
        assert cost.min() > 0 and (2.0 ** -((cost - 1.0) / lm.NAMED)).sum() <= 1 + 1e-6 and (lm.naming(np.zeros(2), np.ones(2)) == 0).all()
    assert lm.listing(np.array([0, 2, 10**9]), np.array([5, 2, 10**9])).tolist()[0] == 0 < lm.listing(np.array([2]), np.array([2]))[0]


def test_lm_knows_texts_that_occur_again(spark):
    rng = random.Random(5)
    from tests.llm.conftest import prose

    texts = [prose(rng, 120) for _ in range(120)]
    docs = spark.createDataFrame([(i, texts[i % 100]) for i in range(120)], "doc_id long, text string")
    got = lm.score(docs).collect()
    twice = [r.bits_per_byte for r in got if r.doc_id % 100 < 20 and all(zlib.crc32(str(k).encode()) % 7 not in (2, 5) for k in (r.doc_id % 100, r.doc_id % 100 + 100))]
    once = [r.bits_per_byte for r in got if 20 <= r.doc_id < 100]
    assert len(twice) > 8 and max(twice) < min(once)


# ---- 2, 3


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    stems = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ban", "dor", "fel", "gis", "hum")]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(stems) for _ in range(rng.randint(20, 80))]
        bad, shout = i % 4 == 0, i % 5 == 0
        if bad:
            for k in range(0, len(w), 12):
                w[k] = rng.choice(["gronkel", "vexatious", "blorf"]) + rng.choice(["", "s", "x"])
        text = " ".join(w)
        docs.append((i, text.upper() if shout else text))
        labels.append((i, int(not shout), int(bad)))
    labels += [(3, None, None), (None, 1, 1), (100000, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "limit"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifier_on_held_out_documents(labelled, operator, label, limit):
    docs, labels = labelled
    got = operator.classify(docs, labels).join(labels, "doc_id").where(f"held_out and {label} is not null").collect()
    assert len(got) > 50
    assert sum(r.predicted == r[label] for r in got) / len(got) >= limit


def test_toxicity_catches_unseen_misspellings(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    some = spark.createDataFrame([(1, "kaban lodor gronkell mifel negis puhum"), (2, "kaban lodor mifel negis puhum raban")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    assert got[1] > 0.5 > got[2]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifier_odd_rows(spark, edge_docs, empty_docs, labelled, operator):
    got = operator.classify(edge_docs, labelled[1]).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert operator.classify(empty_docs, none).count() == 0
    assert len({r.score for r in operator.classify(edge_docs, none).collect()}) == 1


# ---- 4


def brute_targets(sizes, cycle=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: cycle[i % 3] for i, s in enumerate(order)}, sum(sizes.values())
    target, capped = {}, set()
    while True:
        left, share = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def test_mixing(edge_docs, empty_docs):
    first, again = (rows_of(mixing.mix(x), "doc_id", "size", "source_size", "target", "taken") for x in (edge_docs, edge_docs.repartition(5)))
    assert first == again
    docs = edge_docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(words(r.text))
    want = brute_targets(dict(sizes))
    taken, most = Counter(), Counter()
    for r in mixing.mix(edge_docs.withColumn("s", F.col("source")), chunk=16, carry=("s",)).collect():
        assert abs(r.target - want[r.s]) < 1e-6 and r.source_size == sizes[r.s] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.s] += r.taken
        most[r.s] = max(most[r.s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] + 1e-6 for s in sizes)
    assert mixing.mix(empty_docs).count() == 0 and mixing.repeated(empty_docs).count() == 0


def test_mixed_corpus_has_each_row_as_often_as_it_was_taken(edge_docs):
    words_taken = mixing.mix(edge_docs.withColumn("k", F.xxhash64(*edge_docs.columns)), carry=("k",)).agg(F.sum("taken")).first()[0]
    mixed = mixing.repeated(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == words_taken


def test_trades_keep_words_and_odds():
    import pandas as pd

    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 200)
    hits = np.zeros(200)
    for seed in range(300):
        u = np.random.default_rng(seed).random(200)
        rows = pd.DataFrame({"doc_id": [str(i) for i in range(200)], "size": size, "_key": np.arange(200), "_part": size * 0.3, "_take": -1, "_u": u})
        out = mixing.round_chunk(rows, True).set_index("doc_id").loc[rows["doc_id"]]
        assert abs((out["_take"].to_numpy() * size).sum() - size.sum() * 0.3) <= 60
        hits += out["_take"].to_numpy()
    assert abs(hits.mean() / 300 - 0.3) < 0.02 and hits.min() > 30


# ---- 5


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        got = training_order.feistel(np.arange(n), n, 99)
        assert sorted(got.tolist()) == list(range(n))
        assert (training_order.unfeistel(got, n, 99) == np.arange(n)).all()


def test_training_order_round_trip(spark, edge_docs, empty_docs, tmp_path):
    ordered = training_order.training_order(edge_docs, seq_len=32, shard_slots=64)
    got = ordered.collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and {len(r.tokens) for r in got} == {64}
    assert all(r.shard == r.slot // 64 and r["at"] == r.slot % 64 * 64 for r in got)
    tool = training_order.encoding(training_order.read_ranks(training_order.TOKENIZER))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        by[r.doc_id].append(r)
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for i in (0, 5, 100, 101, 106):
        ids = [t for r in by[i] for t in np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()]
        assert ids[-1] == 50256 and tool.decode(ids[:-1]) == texts[i]
    path = str(tmp_path / "shards")
    training_order.write_shards(ordered.where("shard < 2"), path)
    training_order.write_shards(ordered, path)  # goes on where it stopped
    back = {r.slot: bytes(r.tokens) for r in training_order.read_shards(spark, path, start=70).collect()}
    assert back == {r.slot: bytes(r.tokens) for r in got if r.slot >= 70}
    assert training_order.training_order(empty_docs).count() == 0


# ---- 6


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "ü" * 5000), (None, "http://e", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (None, "http://f", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as n_records", "'z' as record_type")
    got = rows_of(warc.round_trip(df, archive_bytes=4000), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    import base64

    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        last = max((p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None), default=None)
        again = last is not None and i != last
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None, None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_rejects_what_is_broken(spark):
    good = [warc.record("response", str(i), "http://x", b"body %d" % i, None) for i in range(3)]
    archive = warc.pack(good, 512, 3)
    assert list(warc.unpack(archive)) == good
    short, wrong = good[0].replace(b"body 0", b"body"), good[1].replace(b"body 1", b"BODY 1")
    rows = spark.createDataFrame([("ok", archive), ("cut", archive[:-3]), ("bad", warc.pack([short, wrong, good[2]], 512, 3)), ("none", None)], "archive_id string, content binary")
    got = defaultdict(list)
    for r in warc.read_archives(rows).collect():
        got[r.archive_id].append(r.error)
    assert got["ok"] == [None] * 3 and got["none"] == []
    assert got["cut"][-1] is not None and [e is None for e in got["bad"]] == [False, False, True]


# ---- 7


def brute_components(docs):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset()) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and 100 * both >= 80 * len(sets[a][1] | sets[b][1]) and sets[b][1]:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def near_copies(seed, n, sizes=(4, 200)):
    """Texts of many sizes in groups whose members differ by edits around the threshold, with passages that all share."""
    from tests.llm.conftest import prose

    rng = random.Random(seed)
    passage, out = prose(rng, 40), []
    while len(out) < n:
        base = prose(rng, rng.randint(*sizes)).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [rng.choice("abcdefgh") * 3] * rng.randint(0, 2)
            out.append(" ".join(w) + (" " + passage) * (rng.random() < 0.3))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("modes", [None, {k: jaccard_join.DELETE for k in range(20)}])
def test_jaccard_join_finds_every_link(spark, modes):
    docs = near_copies(11, 260) + [(1000 + i, t) for i, t in near_copies(12, 60, (5, 12))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(jaccard_join.join(df, modes=modes), "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_jaccard_join_odd_rows(edge_docs, empty_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(jaccard_join.join(edge_docs), "doc_id", "n_shingles", "component_id") == brute_components(docs)
    assert jaccard_join.join(empty_docs).count() == 0
    kept = jaccard_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = Counter(" ".join(w.decode() for w in words(r.text)) for r in kept.collect())
    assert texts[""] == 3 and all(v == 1 for k, v in texts.items() if k)
    assert {r.doc_id for r in kept.collect()} >= {5, 7, 100, 101, 102, 105, 106} and not {103, 104} & {r.doc_id for r in kept.collect()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (302, 301), (302, 302)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {k: 300 for k in (300, 301, 302)}


# ---- 8


def test_page_text(spark):
    html = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-menu"><nav><ul><li><a>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this page, as all pages do, and say so at length.</div><article><h1>A   title</h1><p>First &amp; long paragraph
    with&nbsp;much text in it, so that it counts.<p>Second one is <b>bold</b>, <i>and</i> also rather long for what it says.<br>After a break.</p><p>Of.</p></article>
    <section class="comments"><p>A reader's long comment that nobody asked for, though it has many words in it.</p></section><aside>Side</aside><form><p>Form text</p></form><footer>&copy; us</footer></body></html>"""
    want = "A title\n\nFirst & long paragraph with much text in it, so that it counts.\n\nSecond one is bold, and also rather long for what it says. After a break.\n\nOf."
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (None, "u", "plain &lt;text&gt;"), (1, "u", html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text_", "'q' as n")
    got = rows_of(html_text.main_text(df), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "u", "", 0), (4, "u", "", 0), (None, "u", "plain <text>", 12)], key=repr)
    assert html_text.main_text(df.limit(0)).count() == 0


# ---- 9


def test_telephony_tables_and_steps():
    mu, a = telephony.TABLES[telephony.MULAW].astype(int), telephony.TABLES[telephony.ALAW].astype(int)
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (50, 68), dtype=np.uint8)
    out = telephony.decode_ima(blocks)
    for k in (0, 17, 49):
        value, index = int.from_bytes(blocks[k, :2].tobytes(), "little", signed=True), min(88, int(blocks[k, 2]))
        want = [value]
        for byte in blocks[k, 4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                move = (2 * (code & 7) + 1) * step >> 3
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                want.append(value)
        assert out[k].tolist() == want


def test_text_media(spark, edge_docs, empty_docs):
    got = telephony.text_media(edge_docs, keep_media=True).collect()
    want = []
    for r in edge_docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in got)
    assert {r.codec for r in got} == {"mulaw", "alaw", "ima"}
    assert len({(r.payload_sha256) for r in got}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in got})
    assert telephony.text_media(empty_docs).count() == 0
    broken = spark.createDataFrame([(1, bytes(got[0].media)), (2, bytes(got[0].media)[:-5]), (3, None)], "id int, media binary")
    read = {r.id: r for r in telephony.decode_media(broken).collect()}
    assert read[1].pcm == got[0].pcm and read[2].pcm is None and read[2].error and read[3].pcm is None and read[3].error is None


# ---- 10

TEST_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = TEST_WORD.findall((t or "").encode().lower())
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(n, len(w))])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = TEST_WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= own
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2 << 20, 60])
def test_decontamination(spark, edge_docs, empty_docs, block):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    by = dict(docs)
    items = [(1, "x " + " ".join(by[3].split()[2:20]) + " y"), (2, " ".join(by[3].split()[2:20])), (3, "größe, été"), (4, None), (5, ""), (None, " ".join(by[106].split()[500:530])), (6, by[0]), (6, by[1]), (7, "not in any text at all ever, of that we are sure")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.report(edge_docs, bench, block_bytes=block), *names) == brute_leaks(docs, items)
    clean = decontaminate.clean(edge_docs, bench, block_bytes=block)
    assert clean.columns == edge_docs.columns and clean.count() == sum(not r[5] for r in brute_leaks(docs, items))
    assert decontaminate.report(empty_docs, bench).count() == 0
    assert decontaminate.report(edge_docs, bench.limit(0)).where("contaminated").count() == 0


def test_longest_matches(spark):
    text = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["a", "b"] + text[5:40] + ["c"])), (2, " ".join(text[50:58]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(text))], "item_id long, text string")
    assert rows_of(decontaminate.longest_matches(docs, bench), "doc_id", "item_id", "doc_word", "item_word", "n_words") == [(1, "9", 2, 5, 35)]


def test_words_are_those_of_bytes_split():
    from chronoweave.llm import words as W
    from chronoweave.llm.common import buffers

    texts = [b"", b"  a b\tc\x0b\x0cd\r\ne ", "é\x85 x\x1fy".encode(), b"same", b"same same"]
    data, offsets = buffers(pa.array(texts, pa.binary()))
    starts, ends, first = W.spans(data, offsets, W.SPACE == 0)
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [t.split() for t in texts]
    h = W.hashes(data, starts, ends)
    assert len(set(h[first[3] :].tolist())) == 1
