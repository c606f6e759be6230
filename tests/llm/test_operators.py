"""Operators against brute force on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import bpe, common, fingerprints, langid, line_crf, line_dedup, ngram_join, packing, ppm, quality_rules, recompress
from tidewater.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, g int, row string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "k", 1, "r", 2) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def corpus(seed=1, n=60, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Été", "naïve", "#$%", "a" * 300]
    line = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
    texts = ["\n".join(line(1, 25) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    for _ in range(n // 3):
        a, b = rng.choice(texts), rng.choice(texts)
        w = a.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [a, " ".join(w), a + "\n" + b, " ".join(["x"] * rng.randint(1, 60))]
    return texts + [None, "", " \n\t ", "one", "x " * 200, "ab " * 90 + "\n" + "ab " * 40]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_quality_counts(spark, texts):
    for i, r in enumerate(quality_rules.features(make(spark, texts)).select("row.doc_id", "*").orderBy("doc_id").collect()):
        text = texts[i] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_learn_and_spare(spark):
    rng = random.Random(0)
    good = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(120)]
    bad = [" ".join(f"w{rng.randrange(900)}$$$" for _ in range(80)) for _ in range(60)]
    docs = make(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == set(range(120))
    assert quality_rules.keep_good(docs, labels.limit(0)).count() == 180
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_fingerprints(spark, texts):
    ids = list(range(len(texts) - 1)) + [None]
    got = {r["doc_id"]: r for r in fingerprints.with_next(make(spark, texts, ids)).collect()}
    order = sorted(range(len(texts)), key=lambda i: -1 if ids[i] is None else ids[i], reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        t, nxt = texts[a] or "", texts[b] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[ids[a]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"].encode(), r["edited_fingerprint"].encode()) == tuple(fingerprints.fingerprints([t, edited]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.with_next(make(spark, texts).limit(0)).count() == 0


def test_fingerprints_tell_edits_from_other_texts(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    a = text()
    near = a[:1000] + "!" + a[1000:]
    f = fingerprints.fingerprints([a, near, text()])
    assert fingerprints.likeness(f[0], f[1]) > 0.6 > 0.2 > fingerprints.likeness(f[0], f[2])
    found = fingerprints.fingerprint(make(spark, [a, a, text()]))
    assert [(r["a"], r["b"]) for r in fingerprints.similar(found).collect()] == [(1, 0)]


def test_fingerprints_tell_short_texts_apart(spark):
    rng = random.Random(7)
    texts = ["This.", "Die tz.", "Ereaea.", "a", "b", *["".join(rng.choices("abcdefghijklmnop .", k=k)) for k in (3, 5, 8, 10, 14) for _ in range(20)]]
    texts = list(dict.fromkeys(texts))
    made = fingerprints.fingerprints(texts)
    assert all(made)
    assert all(len(x) >= len(t) for t, x in zip(texts, made))
    assert fingerprints.likeness(made[0], made[1]) < 0.5 and fingerprints.likeness(made[1], made[2]) < 0.5
    assert len(set(made)) == len(texts)
    assert fingerprints.fingerprints(["", "a"])[0] == b""
    found = fingerprints.fingerprint(make(spark, ["This.", "Die tz.", "Ereaea.", "This."]))
    assert [(r["a"], r["b"]) for r in fingerprints.similar(found).collect()] == [(3, 0)]


def test_similar_equals_brute_force(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n))

    def changed(x, many):
        x = list(x)
        for k in rng.sample(range(len(x)), min(many, len(x))):
            x[k] = rng.choice("0123456789abcdef")
        return "".join(x)[: len(x) - rng.randint(0, len(x) // 10)]

    prints = ["", ""]
    for n in (1, 2, 3, 4, 6, 9, 17, 33, 65, 300, 900):
        base = digits(n)
        prints += [base, base] + [changed(base, rng.randint(0, max(1, n // 5))) for _ in range(8)] + [digits(n)]
    head = digits(70)
    twins = [head + digits(330)] + [changed(digits(70) + x[70:], 5) for x in [head + digits(330)] * 6]  # alike but for their beginnings
    prints += twins + [head + x[70:] for x in twins[1:3]]
    rng.shuffle(prints)
    alike = lambda a, b: fingerprints.likeness(prints[a].encode(), prints[b].encode())
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if alike(a, b) >= 0.8]
    found = spark.createDataFrame(list(enumerate(prints)), "doc_id bigint, fingerprint string").repartition(3)
    got = fingerprints.similar(found).collect()
    assert all(r["a"] > r["b"] and r["likeness"] == alike(r["a"], r["b"]) >= 0.8 for r in got)
    assert components(len(prints), [(r["a"], r["b"]) for r in got]) == components(len(prints), pairs)


def test_bands_suffice_for_all_lengths():
    for share in (0.5, 0.8125, 0.9):
        for n in range(1, 300):
            for m in range(n, int(n / share + 1e-9) + 1):
                both = set(fingerprints.band_widths(n, share)) & set(fingerprints.band_widths(m, share))
                assert any(n // w > int((1 - share) * m + 1e-9) - (m - n) for w in both)


def brute_ppm(train, text, order):
    seen = defaultdict(Counter)
    for x in train:
        s = [255] * order + list(x.encode()) + [255]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = [255] * order + list(text.encode()) + [255], 0.0
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            left = {a: b for a, b in seen.get(tuple(s[i - k : i]), {}).items() if a not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            out |= set(left)
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("most", [200_000, 5])
def test_ppm(spark, most):
    texts = corpus(3, 25) + ["ZZ unseen Words"]
    got = rows(ppm.score_held_out(make(spark, texts), order=3, max_words=most))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [t or "" for i, t in enumerate(texts) if not held(i)]
    words = lambda t: [*[x.lower() for x in (t or "").encode().split()], None]
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        r = got[i]
        own = words(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    for i in list(range(0, len(texts), 7)) + [len(texts) - 1]:
        assert got[i]["score"] == pytest.approx(brute_ppm(train, texts[i] or "", 3))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_counts_every_gram_beyond_the_broadcast_ones(spark, order):
    texts = corpus(3, 12) + ["ZZ unseen Words", "w1 w2 qq"]
    got = rows(ppm.score(make(spark, texts), make(spark, texts[:-2]), order=order, max_nodes=40, max_words=5))
    for i in range(0, len(texts), 4):
        assert got[i]["score"] == pytest.approx(brute_ppm([t or "" for t in texts[:-2]], texts[i] or "", order))
    for i in (-2, -1):
        assert got[len(texts) + i]["score"] == pytest.approx(brute_ppm([t or "" for t in texts[:-2]], texts[i], order))


def test_ppm_adapts_and_takes_empty_tables(spark, texts):
    assert ppm.adaptive_bits(b"ab" * 200) < ppm.adaptive_bits(bytes(random.Random(0).choices(range(97, 123), k=400)))
    docs = make(spark, ["aa", None])
    assert ppm.score(docs.limit(0), docs).count() == 0
    assert ppm.score(docs, docs.limit(0)).count() == 2


def _log_of_sums(word, place, units):
    """log10 of the sums over segmentations by fractions, each piece's chance a multiple of 2 ** -40."""
    from fractions import Fraction

    out = []
    for j in range(3):
        sums = [Fraction(1)]
        for b in range(1, len(word) + 1):
            sums.append(sum(sums[b - k] * Fraction(units[place[bytes(word[b - k : b])]][j], 2**40) for k in (1, 2, 3) if b >= k and bytes(word[b - k : b]) in place))
        x = sums[-1]
        out.append((math.log2(x.numerator) - math.log2(x.denominator)) * math.log10(2))
    return out


def test_language(spark):
    seg = langid.Segmenter([b"a", b"b", b" a", b"ab", b" ab"] + [bytes([c]) for c in range(256) if c not in b"ab"])
    p = np.random.default_rng(0).random((seg.size + 1, 1))
    p[-1] = 0
    place = {piece: i for i, piece in enumerate([b"a", b"b", b" a", b"ab", b" ab"] + [bytes([c]) for c in range(256) if c not in b"ab"])}

    def total(s):
        return 1.0 if not s else sum(p[place[s[:k]], 0] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in place)

    for word in (b" ab", b" abab", b" bba"):
        assert seg.forward(np.frombuffer(word, np.uint8)[None, :], p)[0, 0] == pytest.approx(math.log10(total(word)))
    rng = random.Random(2)
    wide = np.random.default_rng(1).random((seg.size + 1, 3)) / 50
    wide[-1] = 0
    for n in (1, 2, 7, 30):
        word = np.frombuffer(b" " + "".join(rng.choices("abc", k=n)).encode(), np.uint8)
        assert seg.forward_long(word, wide) == pytest.approx(seg.forward(word[None, :], wide)[0])
        weight = np.array([2.0, 0.5, 0.0])
        assert seg.expected_long(word, weight, wide) == pytest.approx(seg.expected(word[None, :], weight[None, :], wide))
        split = np.zeros_like(wide)  # expected uses are the slope of the log of the sum
        for k in (0, 3, 4):
            up = wide.copy()
            up[k] *= 1 + 1e-6
            split[k] = (seg.forward_long(word, up) - seg.forward_long(word, wide)) * math.log(10) / 1e-6 * weight
        assert split[[0, 3, 4]] == pytest.approx(seg.expected_long(word, weight, wide)[[0, 3, 4]], abs=1e-4)
    word = np.frombuffer(("".join(rng.choices("ab", k=1500)) + "z" * 500).encode(), np.uint8)
    units = [[int(x * 2**40) for x in row] for row in wide]
    got = seg.forward_long(word, np.array(units, float) / 2**40)
    scaled = _log_of_sums(word, place, units)
    assert got == pytest.approx(scaled, rel=1e-9)
    lexicon = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"]}
    data = [(i, " ".join(rng.choices(lexicon[k], k=12)), k) for i, k in enumerate("xy" * 40)] + [(200, None, "x"), (201, "123 !!", "y"), (202, "z" * 500, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = rows(langid.predict_held_out(docs, tokenizer_path("piece_bpe_32k.model")))
    assert all(got[i]["lang_pred"] == k for i, _, k in data[:80])
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (200, 201)] == [("und", 0.0)] * 2
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = rows(langid.predict(docs, docs.limit(0), tokenizer_path("piece_bpe_32k.model")))
    assert {r["lang_pred"] for r in none.values()} == {"und"}


def test_field_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    score, turn, first = rng.standard_normal(7), rng.standard_normal((2, 2)), np.array([0, 4, 4, 7])
    chance, _, partition = line_crf.chains(score, turn, first)
    for t, (a, b) in enumerate(zip(first, first[1:])):
        weight = {y: math.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(turn[u, v] for u, v in zip(y, y[1:]))) for y in product((0, 1), repeat=b - a)}
        z = sum(weight.values())
        if b > a:
            assert partition[t] == pytest.approx(math.log(z))
        for i in range(b - a):
            assert chance[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)


def test_field_classifies(spark):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(f"word{rng.randrange(99)}" for _ in range(9)) + "." for _ in range(5))
    bad = lambda: "\n".join(" ".join(f"w{rng.randrange(99)}$$$" for _ in range(9)) for _ in range(5))
    docs = make(spark, [good() if i % 2 else bad() for i in range(160)] + [None, "", "\n\n"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(161, None)], "doc_id bigint, quality int")
    got = rows(line_crf.classify_held_out(docs, labels))
    assert all(got[i]["predicted"] == i % 2 for i in range(160))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = rows(line_crf.classify(docs, labels.limit(0).selectExpr("doc_id", "'' AS text", "quality")))
    assert all(r["score"] == pytest.approx(0.5) for r in none.values())


def test_bpe(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = ["<|endoftext|> x", "  two  spaces ", "tab \t x", " nbsp  y", "日本語 🤷🏽‍♀️ x", "it's we'LL", "a\r\n b", "\x1c x \x85", "é ñ"]
    all_ = texts + hard
    got = rows(bpe.round_trip(make(spark, all_), tokenizer_path("byte_bpe_50k.json")))
    for i, t in enumerate(all_):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), t
        assert got[i]["exact"] and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(make(spark, hard), tokenizer_path("byte_bpe_50k.json"), offsets=True)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded.select("doc_id", "ids"), tokenizer_path("byte_bpe_50k.json")).collect()}
    assert [back[i] for i in range(len(hard))] == hard
    assert all(len(r["ids"]) == len(r["offsets"]) for r in encoded.collect())
    c = bpe.Codec(tokenizer_path("byte_bpe_50k.json"))
    assert "".join(c.decode_stream(own.encode_ordinary("🤷🏽‍♀️日本"))) == "🤷🏽‍♀️日本"


def brute_links(sets, percent=80):
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_line_dedup(spark):
    texts = corpus(8, 40, 12)
    seen, want = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(line.encode().lower().split())
            if len(line.encode().split()) >= 5:
                if any(100 * len(w & x) >= 80 * len(w | x) for x in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            kept.append(line)
        want.append("\n".join(kept) if t is not None else None)
    for tries in (1, 4):
        got = rows(line_dedup.remove_matches(make(spark, texts), min_words=5, tries=tries, keep=("lang", "k")))
        assert [got[i]["kept"] for i in range(len(texts))] == want
        assert {(r["keep0"], r["keep1"]) for r in got.values()} == {("en", "k")}
    assert line_dedup.remove_matches(make(spark, texts).limit(0)).count() == 0
    twice = make(spark, ["a b c d e f"] * 2 + [None], [7, 7, None])
    assert line_dedup.remove_matches(twice).count() == 3


def test_line_dedup_compares_long_lines_of_different_sizes(spark):
    texts = [" ".join(f"{name}{i}" for i in range(n)) for name, sizes in (("a", (4200, 4300)), ("b", (4300, 4200)), ("c", (4100, 5200))) for n in sizes]
    got = rows(line_dedup.remove_matches(make(spark, texts)))
    assert [got[i]["n_removed"] for i in range(len(texts))] == [0, 1, 0, 1, 0, 0]


def test_workers_dont_collect_what_libraries_made(spark):
    def left(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"frozen": [gc.get_freeze_count()], "left": [len(gc.get_objects())]})

    got = spark.range(1).coalesce(1).mapInArrow(common.tidied(left), "frozen bigint, left bigint").first()
    assert got["frozen"] > 10_000 and got["left"] < 10_000, got


def test_line_dedup_kernels():
    rng = np.random.default_rng(5)
    for _ in range(60):  # lines taken out of texts
        texts = ["\n".join(rng.choice(["", " ", "a", "b c", "ä d e"], rng.integers(0, 7))) for _ in range(rng.integers(1, 9))]
        lines = line_dedup.Lines(pa.array(texts), 1)
        words = [[x.split() for x in t.split("\n")] for t in texts]
        assert [(d, p, n) for d, p, n in zip(lines.doc, lines.place, lines.size)] == [(d, p, len(w)) for d, t in enumerate(words) for p, w in enumerate(t) if w]
        data, base = common.text_bytes(pa.array(texts))
        _, _, doc, place, begin = line_dedup.worded(data, base, common.word_starts(data, base)[0], 1)
        gone = rng.random(len(doc)) < rng.choice([0, 0.5, 1])
        out, ends = line_dedup.without(data, base, np.flatnonzero(data == 10), doc[gone], place[gone], begin[gone])
        drop = set(zip(doc[gone], place[gone]))
        want = ["\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in drop) for d, t in enumerate(texts)]
        assert [bytes(out[i:j]).decode() for i, j in zip(ends, ends[1:])] == want

    words = common.mix(np.arange(1, 40_001, dtype=np.uint64))  # more than the slots tried first
    wanted = common.mix(np.arange(60_000, dtype=np.uint64))
    found = line_dedup.Ranks(words).find(wanted)
    assert (found == np.where((np.arange(60_000) > 0) & (np.arange(60_000) <= 40_000), np.arange(60_000) - 1, -1)).all()
    assert (line_dedup.Ranks(words[:0]).find(wanted) == -1).all()

    def sets(members):  # of ranks up to 100, and of words without one from there on
        ranks = [sorted(x for x in m if x < 100) for m in members]
        tails = [sorted(common.mix(np.array([x], np.uint64))[0] for x in m if x >= 100) for m in members]
        shape = np.array([(len(a) + len(b), len(b)) for a, b in zip(ranks, tails)], line_dedup._SHAPE)
        low, tail = np.array(sum(ranks, []), np.uint16), np.array(sum(tails, []), np.uint64)
        return line_dedup.Sets(np.arange(len(members), dtype=np.uint64), np.arange(len(members)), shape, low, (low * 0).astype(np.uint8), tail)

    a, b = ([set(rng.integers(0, 130, rng.integers(1, 40)).tolist()) for _ in range(50)] for _ in "ab")
    assert sets(a).common(sets(b)).tolist() == [len(x & y) for x, y in zip(a, b)]

    for top in (50, 2**63 - 1):  # null ids are the largest number
        k, p = rng.choice([-(2**63), 3, 4, top], 300), rng.integers(0, 5, 300).astype("i4")
        code = common.mix((k.view("u8") * np.uint64(8) + p.astype("u8")) * np.uint64(2) + rng.integers(0, 2, 300).astype("u8"))
        order = sorted(set(zip(k.tolist(), p.tolist(), code.tolist())))
        assert (line_dedup._in_order(k, p, code) - 1).tolist() == [order.index(x) for x in zip(k.tolist(), p.tolist(), code.tolist())]


def test_line_dedup_query_and_stage_take_short_lines(spark, tmp_path):
    import corpus_pipeline
    from tidewater.llm import queries

    texts = corpus(8, 40, 12) + ["one", "w1 w2\nw2 w1\n\nw1 w1 w2", "a b c d", "a b c d\na b c", "A B\nz"]
    every, whole = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(line.encode().lower().split())
            if not (w and any(100 * len(w & x) >= 80 * len(w | x) for x in every)):
                kept.append(line)
            every.append(w)
        whole.append("\n".join(kept))
    make(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(queries.op6_line_dedup(spark, str(tmp_path)))
    assert [got[i]["kept_sha256"] for i in range(len(texts))] == [hashlib.sha256(t.encode()).hexdigest() for t in whole]
    got = rows(corpus_pipeline.dedup_lines(spark, make(spark, texts), str(tmp_path)))
    assert [got[i]["text"] or "" for i in range(len(texts))] == whole


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_ngram_join(spark, block):
    rng = random.Random(6)
    base = [f"v{rng.randrange(40)}" for _ in range(60)]
    near = []
    for _ in range(50):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"n{rng.randrange(9)}"
        near.append(" ".join(w))
    texts = near + corpus(9, 30)
    sets = shingle_sets(texts)
    want = components(len(texts), brute_links(sets))
    docs = make(spark, texts)
    if block == 2048:
        got = rows(ngram_join.near_duplicates(docs))
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    else:
        found, labels = ngram_join.join(docs, block=block)
        label = {r["cls"]: r["label"] for r in labels.collect()}
        groups = defaultdict(set)
        for r in found.filter("n_shingles > 0").collect():
            groups[label.get(r["cls"], r["cls"])].add(r["doc_id"])
        assert {min(g): g for g in groups.values()} == {k: {i for i, x in enumerate(want) if x == k and sets[i]} for k in {x for i, x in enumerate(want) if sets[i]}}


def test_ngram_join_edges(spark):
    assert ngram_join.near_duplicates(make(spark, ["a"]).limit(0)).count() == 0
    got = ngram_join.near_duplicates(make(spark, ["a b", "A  b", None, "", "a b"], [5, 3, 1, None, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("1", 0, "1"), ("3", 1, "3"), ("5", 1, "3"), ("None", 0, "None"), ("None", 1, "3")]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    hard = texts + ["Straße ΣΑΣ İx 'S 's", "<|endoftext|>", "éa ́b"]
    got = packing.pack_documents(make(spark, hard), tokenizer_path("word_bpe_49k.json"), size=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(hard):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)], t
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 64
    assert len(seqs) <= 1.1 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack_documents(make(spark, texts).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def brute_repeats(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 40])
def test_repeats(spark, vocabulary):
    rng = random.Random(vocabulary)
    passage = [" ".join(f"p{rng.randrange(max(2, vocabulary))}" for _ in range(rng.randint(18, 60))) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [" ".join(f"p{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passage))
        texts.append("\n".join(parts))
    texts += [None, "", "x " * 19, "x " * 20, "x " * 50, texts[0], texts[1] + " " + texts[1]]
    got = rows(recompress.remove_repeats(make(spark, texts), keep=("k", "text")))
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_edges(spark):
    assert recompress.remove_repeats(make(spark, ["a"]).limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(30))
    got = recompress.remove_repeats(make(spark, [long] * 4, [3, 3, None, 9])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("3", 0), ("3", 0), ("9", 30), ("None", 30)]


def test_recompression_shares_a_symbol_in_every_window():
    from tidewater.llm.common import Words

    rng = random.Random(11)
    for vocabulary in (2, 3, 50):
        inner = [f"a{rng.randrange(vocabulary)}" for _ in range(20)]
        for _ in range(40):
            both = [" ".join([f"a{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 12))] + inner + [f"a{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 12))]) for _ in range(2)]
            words = Words(pa.array(both))
            key, start = recompress.keys(words)
            side = words.owner()[start]
            assert set(key[side == 0].tolist()) & set(key[side == 1].tolist())


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = random.Random(4)
    parts = ["don't", "'s", "'tis", "rock'", "ROCK'Stead", "!", "!!", "'", "''", "&&&", "é", "É", "é", "́", "x́...", "0", "a0b!", "10.5", "０", "٣", "İ", "İ", "K", "ß", "中文", "。", "\x85", " ", " ", "-", "#", "<|endoftext|>", "word", "Word.", "a" * 300, "…", "\U0001f600", "\x00", "\x1c"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "\t ", "\x0b", "\x0c", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "0", "a.", "." * 50 + "a" + "." * 50]
    made = packing.WordIds(path)
    for _ in range(2):
        ids, many = made.of(pa.array(texts))
        ends = np.cumsum(many)
        for t, a, n in zip(texts, ends, many):
            assert ids[a - n : a].tolist() == whole.encode(t, add_special_tokens=False).ids, t
        made.CACHE = 3
