"""Operators of the llm package against brute force, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, common, components, decontaminate, exchange, langid, lm, neardup, pii, substrings, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "One two"), (4, "One two"), (None, "no id"), (6, "word " * 30000), (7, "é" * 300), (8, "\x00a\x1cb")]


def docs_of(spark, rows, clash=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in clash:
        df = df.withColumn(c, F.lit("kept"))
    return df


def make_texts(n, seed=0, words=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, words))) for _ in range(n)]


# word hashing


def test_words_and_shingles_match_plain_python():
    texts = [*make_texts(50), "", " ", "A a", "x\x00y\x1cz  Q"]
    data, offsets = common.text_buffer(pa.array(texts))
    hashes, first = common.word_hashes(data, offsets)
    seen = {}
    for d, t in enumerate(texts):
        ws = WORD.findall(t.translate(LOWER))
        assert first[d + 1] - first[d] == len(ws)
        for w, h in zip(ws, hashes[first[d] : first[d + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    token, doc = common.shingle_hashes(hashes, first, 4)
    for d, t in enumerate(texts):
        ws = WORD.findall(t.translate(LOWER))
        want = {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) >= 4 else ({tuple(ws)} if ws else set())
        assert len(set(token[doc == d].tolist())) == len(want)


def test_long_texts_are_hashed_in_spans(monkeypatch):
    texts = [*make_texts(20), "x" * 500, " ".join(make_texts(30, 1))]
    data, offsets = common.text_buffer(pa.array(texts))
    want = common.word_hashes(data, offsets)
    monkeypatch.setattr(common, "SPAN", 64)
    got = common.word_hashes(data, offsets)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_packed_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (exchange.unpack(exchange.pack(keys)) == keys).all()
    assert len(exchange.unpack(exchange.pack(keys[:0]))) == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(60)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op1


def words_of(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute_tiles(a, b, least=3):
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, n))] for n in (40, 25))
        assert decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64)) == brute_tiles(a, b)


def test_repeated_words_cost_little():
    import time

    start = time.time()
    for n in (1, 7, 13):
        x = np.arange(20000, dtype=np.uint64) % np.uint64(n)
        assert decontaminate.tiles(x, x[:5000]) == [(0, 0, 5000)]
    text = "same " * 5000
    data, offsets = common.text_buffer(pa.array([text]))
    assert decontaminate.Benchmark([(1, "same " * 4000)]).hits(data, offsets)[0][0]["coverage"] == 1
    assert time.time() - start < 5


def test_hits_equal_tiling_every_pair(spark):
    """Reordered passages, also in runs of three and four words, short items, and words that many items share."""
    rng = random.Random(4)
    vocab = ["w%d" % k for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for k in range(60)]
    rows = []
    for d in range(300):
        ws, out = items[rng.randrange(60)][1].split(), []
        cuts, i = [], 0
        while i < len(ws):
            n = rng.choice([1, 2, 3, 4, 4, 6])
            cuts.append(ws[i : i + n])
            i += n
        rng.shuffle(cuts)
        for c in cuts:
            out += c + [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
        rows.append((d, " ".join(out)))
    rows += [(900, None), (901, ""), (902, "!?"), (903, "w1"), (904, "x W1, w2 y")]
    got = {r["doc_id"]: {h["item_id"]: (h["coverage"], h["n_tiles"]) for h in r["hits"]} for r in decontaminate.mark(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    n = 0
    for d, t in rows:
        doc, want = words_of(t), {}
        for k, item in items:
            ws = words_of(item)
            least = min(3, len(ws))
            found = brute_tiles(doc, ws, least)
            covered = sum(x for _, _, x in found)
            if covered >= 0.8 * len(ws) - 1e-9:
                want[k] = (covered / len(ws), len(found))
        assert got[d] == want, d
        n += len(want)
    assert n > 100


def test_items_are_found_whole_and_reordered(spark):
    items = make_texts(20, 5, 40)
    items = [t + " unique%d tail%d words%d here%d end%d" % ((k,) * 5) for k, t in enumerate(items)]
    clean = make_texts(30, 99, 200)
    rows = [(k, clean[k] + " ! " + t.upper() + " ? " + clean[k]) for k, t in enumerate(items)]
    half = lambda t: " ".join(t.split()[len(t.split()) // 2 :] + t.split()[: len(t.split()) // 2])
    rows += [(100 + k, clean[k] + " " + half(t) + " " + clean[k]) for k, t in enumerate(items)] + [(200 + k, c) for k, c in enumerate(clean)] + [(300, "Tiny item"), (301, "a tiny item"), (302, None)]
    bench = spark.createDataFrame([*enumerate(items), (50, "tiny item"), (51, None), (52, ""), (3, items[3])], "item_id long, text string")
    out = decontaminate.mark(docs_of(spark, rows, ("hits", "lang")), bench)
    assert "lang" in out.columns
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in out.collect()}
    for k in range(20):
        assert k in got[k] and k in got[100 + k]
    assert got[300] == {50} and got[301] == {50} and not got[302]
    assert all(not got[200 + k] for k in range(30))
    assert all(not r["hits"] for r in decontaminate.mark(docs_of(spark, ODD), bench.limit(0)).collect())


def test_large_benchmarks_take_several_passes(spark, monkeypatch):
    items = [t + " one%d two%d three%d four%d five%d" % ((k,) * 5) for k, t in enumerate(make_texts(12, 3))]
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 500)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontaminate.mark(docs_of(spark, list(enumerate(items))), bench).collect()}
    assert all(k in got[k] for k in range(12))


# op2


def test_toxicity_learns_words_and_their_misspellings(spark):
    rng = random.Random(0)
    base = make_texts(600, 7)
    bad = ["dreadfulness", "abominable", "horrifying"]
    rows = [(k, t + (" " + rng.choice(bad)) * 3 if k % 4 == 0 else t, int(k % 4 == 0)) for k, t in enumerate(base)]
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    fresh = make_texts(40, 8)
    seen = docs_of(spark, [(k, t + " dreadfullness abominabel horifying" if k % 2 else t) for k, t in enumerate(fresh)] + [(-i, t) for i, t in ODD if i] + [(None, "x")], ("score",))
    got = toxicity.score(seen, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    high = [r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] > 0 and r["doc_id"] % 2]
    low = [r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and r["doc_id"] % 2 == 0]
    assert min(high) > max(low)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    assert np.isfinite(toxicity.fit(docs_of(spark, [(k, t) for k, t, _ in rows]), labels, rows=50).bias)
    none = toxicity.fit(docs_of(spark, ODD), labels.limit(0))
    assert toxicity.score(docs_of(spark, ODD).limit(0), none).count() == 0 and toxicity.fit(docs_of(spark, ODD).limit(0), labels).bias < 0
    assert 0 <= toxicity.score(docs_of(spark, ODD), none).agg(F.max("score")).first()[0] <= 0.5


def grams_of(text):
    out = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()):
        m = b"\x01" + w + b"\x02"
        out += [m[i : i + n] for n in (3, 4, 5) for i in range(len(m) - n + 1) if n != len(m)] + [m]
    return out


def bucket(gram):
    x = np.frombuffer(gram, np.uint8)
    return int(common.range_hash(common.prefix_hash(x), np.array([0]), np.array([len(x)]))[0] % np.uint64(toxicity.BUCKETS))


def test_toxicity_scores_equal_a_plain_scorer():
    texts = [*make_texts(60, 3), "", " ", "a", "Éa zz " * 50, "x-y_z 12"]
    labels = [int(k % 3 == 0) for k in range(60)] + [0] * 5
    model = toxicity.train(texts, labels)
    data, offsets = common.text_buffer(pa.array(texts, pa.large_string()))
    for t, got in zip(texts, model.score(data, offsets), strict=True):
        b = [bucket(g) for g in grams_of(t)]
        z = model.bias + sum(model.logit[k] * model.rarity[k] for k in b) / (sum(model.rarity[k] for k in b) + toxicity.SMOOTH)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9
    # Vectors and softmax learnt together tell the classes of their own texts apart.
    own = model.score(*common.text_buffer(pa.array(texts[:60], pa.large_string())))
    y = np.array(labels[:60])
    assert own[y == 1].mean() > own[y == 0].mean() + 0.3


# op3


def brute_topk(rows, k, every):
    out = []
    ok = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    for q in sorted({i for i, _ in ok if i % every == 0}):
        asked = min(x for i, x in ok if i == q)
        cand = sorted((-sum(a * b for a, b in zip(asked, x, strict=True)), i) for i, x in ok if i != q and len(x) == len(asked))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(cand)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_topk_is_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 70)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(300)] + [(i, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (510, [1.0, 2.0]), (520, [3.0, 1.0]), (530, [9.0])]
    rows += [(None, [1.0] * 6), (7, [2.0, 0.0, 0.0, 0.0, 0.0, 3.0]), (10, [9.0] * 6), *rows[:3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.search(topk.integer_rows(df), F.col("vec_id") % 10 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 5, 10)
    assert topk.search(topk.integer_rows(df.limit(0)), F.col("vec_id") % 10 == 0, 5).count() == 0


# op4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.yz", "1", "23", "255", "256", "4444 4444", "4709559030084884", "-", " ", ".", "+1", "(", ")", "é", "٣", "x@y.z", "1.2.3.4"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 200000) == [] and pii.base_spans("a" * 200000 + "@") == []


def test_repeats_of_personal_data_are_added(spark):
    text = "call +1 (988) 555-2485 or 988-555-2485, mail bosbt.42@mail8.example.com, ask bosbt.42 or 123456789."
    docs = docs_of(spark, [(10, text), *ODD], ("spans", "base"))
    model = pii.train(pii_texts())
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    shown = [(text[s["start"] : s["end"]], s["kind"]) for s in got[10]["spans"]]
    assert ("988-555-2485", "phone") in shown and ("bosbt.42", "email") in shown and not any("123456789" in x for x, _ in shown)
    assert {tuple(s) for s in got[10]["base"]} <= {tuple(s) for s in got[10]["spans"]}
    assert got[1]["spans"] == [] and got[2]["spans"] == []
    hidden = pii.find(docs, model, redact=True).where("doc_id = 10").first()["text"]
    assert "555" not in hidden and "bosbt" not in hidden and "[PHONE]" in hidden
    assert (pii.fit(docs.limit(0)).edge == pii.EDGE_PRIOR).all()


def pii_texts(n=200, seed=5):
    """Texts with mentions of every kind, some of them twice, and numbers that are of none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: next(c for c in (d(16) for _ in range(1000)) if pii.luhn(c))
    out = []
    for k, t in enumerate(make_texts(n, seed)):
        one = rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"name{d(3)}@mail{d(1)}.example.com", card(), ".".join(str(rng.randint(1, 255)) for _ in range(4)), d(16), d(9)])
        out.append(f"{t} {one} {t} {one}" if k % 3 == 0 else f"{t} {one}")
    return out


def test_skip_edges_decide_and_base_spans_stay():
    """The ablation: without skip edges the repeats of a phone number and of an address's name get other labels."""
    model = pii.train(pii_texts())
    assert model.edge[pii.SAME] > 1
    text = "call +1 (988) 555-2485 or 988-555-2485, mail name123@mail8.example.com, ask name123 or 123456789, not 4444333322221112"
    base = pii.base_spans(text)
    show = lambda m: {(text[a:b], pii.KINDS[k]) for a, k, b in m.added(text, base)}
    assert ("988-555-2485", "phone") in show(model) and not any(x in ("123456789", "4444333322221112") for x, _ in show(model))
    assert ("988-555-2485", "phone") not in show(pii.Model(model.weights, np.zeros(4)))
    assert pii.one_edit("abc", "abd") and pii.one_edit("abc", "ab") and pii.one_edit("abc", "xabc") and not pii.one_edit("abc", "abc") and not pii.one_edit("abc", "acb")
    near = pii.mentions("u@x.yz 123456789012, 123456789013, 99123456789012", pii.base_spans("u@x.yz 123456789012, 123456789013, 99123456789012"))
    assert {pii.NEAR, pii.TAIL} <= set(pii.edges_of(near).values())


def test_personal_data_of_long_texts_is_linear():
    import time

    model, start = pii.train(pii_texts()), time.time()
    text = " ".join("u%d@x.yz %d" % (i, 10**10 + i * 7919) for i in range(16000))
    base = pii.base_spans(text)
    model.added(text, base)
    assert len(base) == 16000 and time.time() - start < 20


def test_message_passing_agrees_with_enumeration_on_trees():
    rng = np.random.default_rng(0)
    for _ in range(20):
        unary, edges = rng.normal(size=(4, 3)), {(0, 1): 1.3, (1, 2): 0.7, (1, 3): 2.0}
        total = np.zeros((4, 3))
        for lab in np.ndindex(3, 3, 3, 3):
            w = math.exp(sum(unary[i, lab[i]] for i in range(4)) + sum(v for (i, j), v in edges.items() if lab[i] == lab[j]))
            for i in range(4):
                total[i, lab[i]] += w
        assert (pii.propagate(unary, edges) == total.argmax(1)).all()


# op5


def test_languages_equal_a_plain_loop_over_zstandard():
    import zstandard as zstd

    model = [("aa", b"the cat sat on the mat and the dog ran to the house " * 9), ("bb", b"le chat est sur le tapis et le chien court vers la maison " * 9)]
    known = langid.Classifier(model)
    rng = random.Random(0)
    for _ in range(100):
        text = " ".join(rng.choice(rng.choice([b"the cat house dog ran", b"le chat maison chien court"]).decode().split()).title() for _ in range(rng.randint(1, 2000)))
        raw, sizes = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip(), []
        for _, body in model:
            params = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK_BYTES, dict_size=langid.DICT_BYTES, write_content_size=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
            coder = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes.append(sum(len(coder.compress(raw[k : k + langid.BLOCK_BYTES])) for k in range(0, len(raw), langid.BLOCK_BYTES)))
        apart = abs(sizes[0] - sizes[1])
        assert known.classify(text) == ("aa" if sizes[0] <= sizes[1] else "bb", apart / max(sizes), apart < 1 or apart < 0.01 * max(sizes))


def test_language_ties_of_short_texts_are_rejected():
    known = langid.Classifier([("aa", b"the cat sat on the mat "), ("bb", b"le chat est sur le tapis ")])
    assert known.classify("qzxj vwkq") == ("aa", 0.0, True)
    assert known.classify("the cat sat on")[::2] == ("aa", False) and known.classify("le chat est sur")[::2] == ("bb", False)


def test_languages_are_told_apart_and_mixtures_rejected(spark):
    rng = random.Random(0)
    sound = {"aa": "ka lo mi ne pu".split(), "bb": "schra ghee thwo vrix zunt".split()}
    make = lambda l, n: " ".join("".join(rng.choice(sound[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(l, 80), l) for k, l in enumerate(["aa", "bb"] * 60)] + [(900, "hidden", None), (901, None, "aa")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, F.lit(True))
    assert [l for l, _ in model] and {l for l, _ in model} == {"aa", "bb"}
    test = [(k, make(l, 60)) for k, l in enumerate(["aa", "bb"] * 20)] + [(100, "123 !?"), (101, None), (102, ""), (103, make("aa", 4000))]
    got = {r["doc_id"]: r for r in langid.classify(docs_of(spark, test, ("score", "lang_pred")), model).collect()}
    assert all(got[k]["lang_pred"] == ["aa", "bb"][k % 2] and not got[k]["rejected"] and 0 <= got[k]["score"] <= 1 for k in range(40))
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] for k in (100, 101, 102)) and got[103]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in langid.classify(docs_of(spark, ODD), langid.fit(train.limit(0), F.lit(True))).collect()} == {"und"}


# op6


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(vocabulary, spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib, own = tokenizers.Tokenizer.from_file(vocabulary), bpe.Encoder(vocabulary)
    rng = random.Random(0)
    texts = ["", " ", "  a  b\n\n c  ", "<|endoftext|>x <|endoftext|>", "it's I'LL we've 123", "a" * 1000, "ab" * 500, "日本語 🙂🙂", "\x00 a\r\n\tb"]
    texts += ["".join(rng.choice("aabbcc  \n'st12.!éñ　\x1f") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    rows, per = own.encode_unit(texts)
    for t, r in zip(texts, rows, strict=True):
        ids = [i for k in r.tolist() for i in per[k]]
        assert ids == lib.encode(t, add_special_tokens=False).ids == own.encode(t), t
        assert own.decode(ids) == t
    got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, ODD, ("ids",)), vocabulary).collect()}
    assert got[1]["n_tokens"] == 0 and own.decode(got[6]["ids"]) == "word " * 30000
    digest = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, ODD), vocabulary, digest=True).collect()}
    assert digest[4]["decoded_sha256"] == hashlib.sha256(b"One two").hexdigest()
    assert bpe.encode(docs_of(spark, ODD).limit(0), vocabulary).count() == 0


# op7


def test_lm_base_is_exact_and_tokens_are_scored_once(spark, vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    path, pattern = str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN
    rows = [*enumerate(make_texts(150, 4, 120)), (400, None), (401, ""), (402, "Word word WORD"), (402, "Word word WORD"), (403, "seldom " * 3000)]
    held = F.col("doc_id") % 5 == 0
    got = lm.score(docs_of(spark, rows, ("score", "g")), held, path, pattern).collect()
    count = collections.Counter()
    for d, t in rows:
        if d % 5:
            count.update([*WORD.findall((t or "").translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(list)
    for d, t in rows:
        ts = [*WORD.findall((t or "").translate(LOWER)), None]
        want[d].append((len(ts), sum(count[x] > 0 for x in ts), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)))
    assert len(got) == len(rows)
    for r in got:
        a, b, c = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, b, n) and abs(r["base_score"] - c) < 1e-6 * abs(c) and r["score"] < 0
    assert lm.score(docs_of(spark, []), held, path, pattern).count() == 0


def test_lm_probabilities_sum_to_one_and_windows_are_causal(vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    texts = make_texts(120, 4, 120)
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    model = lm.train(texts, np.bincount(ids, minlength=sub.size).astype(float), sub, steps=30)
    h = model.hidden(ids[None, :20])[0, -1]
    every = model.log_probability(np.repeat(h[None], sub.size, 0), np.arange(sub.size))
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-3
    one, two = ids[:200].copy(), ids[:200].copy()
    two[150:] = two[150:][::-1]
    a, b = (model.log10(x, np.array([200]), sub.end) for x in (one, two))
    assert np.allclose(a[:150], b[:150], atol=1e-4)
    start, doc = lm.windows(np.array([1, 8, 9, 32, 33, 100]))
    covered = collections.Counter()
    first = np.concatenate([[0], np.cumsum([1, 8, 9, 32, 33, 100])[:-1]])
    for s, d in zip(start.tolist(), doc.tolist(), strict=True):
        end = min(s + lm.WIDTH, first[d] + [1, 8, 9, 32, 33, 100][d])
        covered.update(range(s if s == first[d] else s + lm.CONTEXT, end))
    assert set(covered.values()) == {1} and len(covered) == 183


def test_words_encoded_in_a_row_equal_each_alone(vocabulary, monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    rng = random.Random(0)
    words = ["".join(rng.choice("aabc12'st.!,é\u00a0\u2003日🙂\x85\x1c%") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["a", "'s", "\u00a0", "1"]
    want = [sub.encode(" " + w) for w in words]
    for row in (7, 20000):
        monkeypatch.setattr(lm.Subwords, "ROW", row)
        ids, at = sub.ids(words)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want
    assert sub.ids([])[1].tolist() == [0]


def test_lm_scores_equal_one_window_at_a_time(vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    texts = [*make_texts(40, 4, 150), ""]
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    model = lm.train(texts, np.bincount(ids, minlength=sub.size).astype(float), sub, steps=30)
    got = model.log10(ids, size, sub.end)
    p, d = {k: v.astype(float) for k, v in model.p.items()}, lm.DIM
    soft = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
    first = 0
    for n in size.tolist():
        mine = ids[first : first + n].tolist()
        before = [sub.end, *mine[:-1]]
        for t in range(n):
            # The window of token t: windows begin every WIDTH - CONTEXT tokens, and score what no earlier one did.
            k = 0 if t < lm.WIDTH else -(-(t + 1 - lm.WIDTH) // (lm.WIDTH - lm.CONTEXT)) * (lm.WIDTH - lm.CONTEXT)
            x = p["vector"][before[k : t + 1]] + p["place"][: t + 1 - k]
            q, key, value = (x @ p["qkv"][:, i * d : i * d + d] for i in range(3))
            a = np.exp(soft(key @ q[-1]))
            h = x[-1] + (a @ value) @ p["mix"]
            g, leaf = model.group[mine[t]], model.leaf[mine[t]]
            want = soft(h @ p["out"] + p["bias"])[g] + soft(h @ p["out2"][g] + p["bias2"][g])[leaf] + model.share[mine[t]]
            assert abs(want / math.log(10) - got[first + t]) < 1e-3
        first += n
    counts = np.array([0, 1, 2**32, 2**40 + 5], np.uint64)
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all() and len(lm.pack_counts(counts[:2])) == 3


def test_lm_learns_from_short_texts_and_ends(vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    texts = ["one two three four", "five six seven"] * 40
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    assert size.max() < lm.WIDTH
    counts = np.bincount(ids, minlength=sub.size).astype(float)
    before, after = (lm.train(texts, counts, sub, steps=n).log10(ids, size, sub.end) for n in (0, 150))
    ends = np.cumsum(size) - 1
    assert after[ends].mean() > before[ends].mean() + 0.3 and after[ends].mean() > -0.2 and after.mean() > -0.5
    at, width = lm.spans(np.array([1, 31, 32, 33, 100]))
    assert sorted(i for a, w in zip(at.tolist(), width.tolist(), strict=True) for i in range(a, a + w)) == list(range(197))


def test_lm_learns_from_documents_outside_the_sample(spark, vocabulary, monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    path, pattern = str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN
    sub = lm.Subwords(path, pattern)
    here, away = "red green blue", "one two three four"
    rows = [(k, here if k < 60 else away if k < 500 else "") for k in range(600)]
    rows += [(1000, "one two three four"), (1001, "four three two one")]
    monkeypatch.setattr(lm, "sample", lambda docs, n: [here] * 60)
    kept = {}
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda texts, counts, subwords: kept.setdefault("m", (real(texts, counts, subwords, steps=20), counts))[0])
    got = {r["doc_id"]: r["score"] for r in lm.score(docs_of(spark, rows), F.col("doc_id") >= 1000, path, pattern).collect()}
    assert got[1000] > got[1001] + 2
    assert abs(got[1000] - got[60]) < 1e-6
    # The scores are those of the corpus's own pairs.
    texts = [t for d, t in rows if d < 1000]
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    pair = collections.Counter()
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        pair.update(zip([sub.end, *ids[a : b - 1].tolist()], ids[a:b].tolist(), strict=True))
    model, counts = kept["m"]
    flat, n = lm.sequences(lm.Words(pa.array([t for _, t in rows[-2:]])), sub)
    before = flat.copy()
    before[1:] = flat[:-1]
    before[np.cumsum(n) - n] = sub.end
    first = collections.Counter(a for a, b in pair.elements())
    assert all(first[k] == counts[k] for k in range(sub.size))
    p = [lm.MIX * 10.0**x + (1 - lm.MIX) * (pair[a, b] + lm.PRIOR * 10.0**x) / (first[a] + lm.PRIOR) for a, b, x in zip(before.tolist(), flat.tolist(), model.log10(flat, n, sub.end).tolist(), strict=True)]
    want = np.add.reduceat(np.log10(p), np.cumsum(n) - n)
    assert np.allclose(want, [got[1000], got[1001]], atol=1e-4)


def test_lm_weights_and_classes_come_from_all_training_documents(spark, vocabulary, monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    path, pattern = str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN
    sub = lm.Subwords(path, pattern)
    texts = make_texts(300, 5, 60)
    rows = [*enumerate(texts), (1000, "one two three four")]
    monkeypatch.setattr(lm, "sample", lambda docs, n: texts[:3])
    monkeypatch.setattr(lm, "FAN", 2)  # several levels of sums
    monkeypatch.setattr(common, "GROUP_BYTES", 4000)
    kept, real = {}, lm.train

    def starting(drawn, counts, subwords):
        model = real(drawn, counts, subwords, steps=20)
        kept.update(model=model, start={k: v.copy() for k, v in model.p.items()}, grouping=subwords.grouping)
        return model

    monkeypatch.setattr(lm, "train", starting)
    docs = docs_of(spark, rows)
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in ("3", before):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        scores.append({r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") >= 1000, path, pattern).collect()})
    assert all(abs(scores[0][d] - scores[1][d]) < 1e-3 for d, _ in rows)  # of no setting of the session
    model, start = kept["model"], lm.Model(kept["start"], kept["model"].group, kept["model"].leaf, kept["model"].share)
    start.seen = model.seen
    # Every id that a training document holds has learnt, in the sample or not, and predicts better.
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    changed = (model.p["vector"] != start.p["vector"]).any(1)
    assert set(np.flatnonzero(changed)) == set(ids.tolist())
    few = lm.sequences(lm.Words(pa.array(texts[:3])), sub)[0]
    assert len(set(ids.tolist())) > len(set(few.tolist()))
    assert model.log10(ids, size, sub.end).mean() > start.log10(ids, size, sub.end).mean()
    # The weights are the average of the groups' passes, by the tokens learnt from.
    parts, n_groups = lm.learners(docs.where("doc_id < 1000"), sum(len(t) + 16 for t in texts))
    by_g = collections.defaultdict(list)
    for r in parts.orderBy("doc_id").collect():
        by_g[r["g"]].append(r["text"])
    assert n_groups > 2
    total, times = np.zeros_like(lm.table_of(start.p), float), 0
    for g, mine in by_g.items():
        one = lm.sequences(lm.Words(pa.array(mine)), sub)
        for r in lm.learn(start, *one, sub.end, g).to_pylist():
            total[np.frombuffer(r["rows"], "<u4")] += np.frombuffer(r["sums"], np.float32).reshape(-1, lm.DIM)
        times += len(one[0])
    assert times == len(ids)
    n = np.append(np.bincount(ids, minlength=sub.size), np.full(len(total) - sub.size, times))
    assert np.allclose((total[n > 0] / n[n > 0, None]), lm.table_of(model.p)[n > 0], atol=1e-4)
    # Classes are those of the corpus's pairs, counted plainly.
    pair = collections.Counter()
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        pair.update(zip([sub.end, *ids[a : b - 1].tolist()], ids[a:b].tolist(), strict=True))
    count = np.bincount(ids, minlength=sub.size).astype(float)
    often = sorted((i for i in set(ids.tolist()) if i != sub.end), key=lambda i: (-count[i], i))[: lm.OFTEN]
    want = {}
    for (a, b), k in pair.items():
        ratio = k * count.sum() / (count[a] * count[b])
        for shift, row, other in ((0, b, a), (lm.OFTEN, a, b)):
            if other in often and row != sub.end and ratio > 1:
                want[row * 2 * lm.OFTEN + shift + often.index(other)] = math.log(ratio)
    keys = np.array([a * sub.size + b for a, b in pair], np.uint64)
    cell, value = lm.cells(keys, np.array(list(pair.values()), float), count, lm.columns(count))
    got = dict(zip(cell.tolist(), value.tolist(), strict=True))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)
    group, vector = lm.classes(cell, value, count, sub.leads, np.random.default_rng(0))
    order = np.argsort(cell)
    same = lm.classes(cell[order], value[order], count, sub.leads, np.random.default_rng(0))
    assert (group == same[0]).all() and (kept["grouping"][0] == group).all() and (kept["grouping"][1] == vector).all()


def test_lm_gradients_equal_differences_of_the_loss(vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    texts = make_texts(60, 4, 90)
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    model = lm.train(texts, np.bincount(ids, minlength=sub.size).astype(float), sub, steps=30)
    n, t, d = 6, lm.WIDTH, lm.DIM
    rng = np.random.default_rng(3)
    spot = rng.integers(1, len(ids) - t, n)[:, None] + np.arange(t)
    before, target = ids[spot - 1], ids[spot].ravel()

    def loss(p):
        total = 0
        for row, want in zip(before, target.reshape(n, t), strict=True):
            x = p["vector"][row] + p["place"][:t]
            q, k, v = (x @ p["qkv"][:, i * d : i * d + d] for i in range(3))
            a = np.exp(q @ k.T) * np.tril(np.ones((t, t)))
            h = x + (a / a.sum(1, keepdims=True)) @ v @ p["mix"]
            for i, c, leaf in zip(h, model.group[want], model.leaf[want], strict=True):
                for z, y in ((i @ p["out"] + p["bias"], c), (i @ p["out2"][c] + p["bias2"][c], leaf)):
                    total += np.log(np.exp(z).sum()) - z[y]
        return total / (n * t)

    h, kept = model.hidden(before, keep=True)
    cell = model.cell[target]
    order = np.argsort(cell, kind="stable")
    back, g = lm._softmax_gradient(model, lm.beside_one(h.reshape(-1, d)[order]), cell[order])
    dh = np.empty((n * t, d), np.float32)
    dh[order] = back[:-1]
    g.update((k, np.zeros_like(model.p[k])) for k in ("place", "qkv", "mix"))
    dx = lm._attention_gradient(model.p, kept, dh.reshape(n, t, d), g)
    g["vector"] = np.zeros_like(model.p["vector"])
    np.add.at(g["vector"], before.ravel(), dx)
    p = {k: x.astype(float) for k, x in model.p.items()}
    for name, grad in g.items():
        # The steepest weights and some others.
        flat = grad.ravel()
        for at in [*np.argsort(-abs(flat))[:4], *rng.integers(0, flat.size, 2)]:
            either = []
            for by in (1e-4, -1e-4):
                moved = p[name].ravel().copy()
                moved[at] += by
                either.append(loss({**p, name: moved.reshape(p[name].shape)}))
            assert abs((either[0] - either[1]) / 2e-4 - flat[at]) < 1e-5 + 1e-3 * abs(flat[at]), (name, at)


def test_lm_probabilities_of_huge_logits_are_capped(vocabulary):
    tok = pytest.importorskip("public_tokenizers")
    sub = lm.Subwords(str(tok.path("byte_bpe_50k.tiktoken")), tok.PATTERN)
    texts = make_texts(60, 4, 90)
    ids, size = lm.sequences(lm.Words(pa.array(texts)), sub)
    model = lm.train(texts, np.bincount(ids, minlength=sub.size).astype(float), sub, steps=5)
    h = model.hidden(ids[None, :20])[0]
    assert not model.capped(h) and model.capped(h * 1e4)
    assert np.isfinite(model.log_probability(h * np.float32(1e4), ids[1:21])).all()


def test_lm_distinct_values_and_their_places():
    for values in (np.array([5, 3, 5, 2**63, 3, 0], np.uint64), np.array([7], np.uint32), np.zeros(0, np.uint64)):
        one, place, which = lm.distinct(values)
        assert one.tolist() == sorted(set(values.tolist())) and (values[place] == one).all() and (one[which] == values).all()


# op8


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cov = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                cov[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~cov].tobytes()
        out.append((len(b), int(cov.sum()), int((cov[1:] & ~cov[:-1]).sum() + cov[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_column_wise_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        offsets, flat, need = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.concatenate(texts), int(rng.integers(1, 5))
        starts = [(i, tuple(flat[i : i + need])) for a, b in zip(offsets, offsets[1:], strict=False) for i in range(a, b - need + 1)]
        count = collections.Counter(s for _, s in starts)
        want = np.zeros(len(flat), bool)
        for i, s in starts:
            want[i] = count[s] > 1
        assert (substrings.repeated_starts(flat, offsets, need) == want).all()
        if not len(flat):
            continue
        # The files hold the collection's transform, suffixes and common prefixes; equal suffixes stand by text.
        with substrings.Columns(len(texts)) as columns:
            values = substrings.build(flat, offsets, columns)
            bwt, at, lcp = (columns.read(c) for c in ("bwt", "at", "lcp"))
        ends = [(t, len(x)) for t, x in enumerate(texts)]
        every = ends + sorted(((t, i) for t, x in enumerate(texts) for i in range(len(x))), key=lambda p: (tuple(texts[p[0]][p[1] :]), p[0]))
        shown = [tuple(texts[t][i:]) for t, i in every]
        assert [tuple(flat[a : offsets[1:][offsets[1:] > a][0]]) for a in at] == shown[len(texts) :]
        got = [0 if b == 0 else values[b - 1] + 1 for b in bwt]
        assert sorted(zip(shown, got, strict=True)) == sorted((s, 0 if i == 0 else texts[t][i - 1] + 1) for s, (t, i) in zip(shown, every, strict=True))
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [0, *[prefix(a, b) for a, b in zip(shown[len(texts) :], shown[len(texts) + 1 :])]]


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_repeated_strings(spark, hot):
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, long_ = letters(450), letters(2500)
    texts = [None, "", "a" * 199, "a" * 200, "a" * 3000, "ab" * 300, "Ingerou " * 100, "é" * 250, long_, long_, long_[50:600]]
    texts += [letters(rng.integers(0, 300)) + passage[rng.integers(0, 200) : rng.integers(220, 450)] + letters(rng.integers(0, 300)) for _ in range(30)]
    for _ in range(15):
        t = list(long_)
        for k in rng.integers(0, 2500, 4):
            t[k] = "A"
        texts.append("".join(t))
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove(docs_of(spark, list(enumerate(texts)), ("g", "b")), hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute_removed(texts)
    assert substrings.remove(docs_of(spark, ODD).limit(0)).count() == 0
    assert substrings.remove(docs_of(spark, ODD)).count() == len(ODD)


# op9


def brute_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common_ = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("frequent", "block"), [(neardup.FREQUENT, neardup.BLOCK_TOKENS), (2, 300)])
def test_components_equal_brute_force(spark, frequent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TOKENS", block)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = random.Random(3)
    rows = list(enumerate(make_texts(60, 9, 80)))
    passage = " ".join("p%d" % k for k in range(25))
    for k in range(120):
        ws = rows[rng.randint(0, 30)][1].split()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = "edit%d" % rng.randint(0, 999)
        rows.append((100 + k, " ".join(ws) if k % 3 else " ".join(ws) + " " + passage))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "w " * 5000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.join(docs_of(spark, rows, ("g", "n")), frequent=frequent).collect()}
    assert got == brute_components(rows, 4, 85)
    assert neardup.join(docs_of(spark, ODD)).count() == len(ODD)
    assert neardup.join(docs_of(spark, ODD).limit(0)).count() == 0


def test_chains_of_shared_rare_shingles_are_not_compared(spark, monkeypatch):
    """Documents that only their neighbours share shingles with: what is compared grows with them, not with their square."""
    n, seen = 3000, []
    real = neardup.verify
    sets = [np.unique(np.concatenate([np.arange(100) + 1000 * i, np.arange(100) + 1000 * (i + 1)])).astype(np.uint64) for i in range(n)]
    keys = [s.view(np.int64) for s in sets]
    pairs = 0
    for i in range(0, n, 3):
        part = range(i, min(n, i + 3))
        areas = [np.array([max(0, k - 1), k]) for k in part]
        pairs += real(i, neardup.Members([sets[k] for k in part], [keys[k] for k in part], areas), None, 85)[2]
    assert pairs <= 2 * n
    words = lambda i: " ".join("w%dx%d" % (i, k) for k in range(30))
    rows = [(i, words(i) + " " + words(i + 1)) for i in range(400)]
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neardup, "verify", lambda *a: seen.append(real(*a)[2]) or real(*a))
    got = neardup.join(docs_of(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_classes"] == 0 for r in got)


def test_long_sets_index_single_tokens():
    rng = np.random.default_rng(0)
    for n in (300, 400, 420, 470, 480, 600):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for m in range(8):
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: -(-85 * len(a) // 100) + m]], rng.integers(0, 1 << 62, m).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                x, y = (neardup.index_keys(t, np.full(len(t), 255, np.uint8), 85, 1024) for t in (a, b))
                assert len(np.intersect1d(x, y)) and len(x) < 3 * neardup.LONG**2


# op10


def test_layouts_escapes_and_masks(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|sep|>", "back\\slash \\<| <<SYS>><</SYS>>", "", None, "<|>", "é🙂 [INST", "\\"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(k, 1, "assistant", t) for k, t in enumerate(texts)] + [(90, None, None, "x"), (91, 0, "assistant", "a"), (91, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(1))
    out = chat.render(chat.canonical_turns(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    for r in out.collect():
        assert r["back"] == r["turns"]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert chat.render(chat.canonical_turns(df.limit(0))).count() == 0
    by = lambda df: [[tuple(t) for t in r["turns"]] for r in chat.canonical_turns(df).collect()]
    assert by(spark.createDataFrame([("a", "b", 1)], "prompt string, response string, score int")) == [[("user", "a"), ("assistant", "b")]]
    assert by(spark.createDataFrame([("do", "", "done")], "instruction string, input string, output string")) == [[("user", "do"), ("assistant", "done")]]
    assert by(spark.createDataFrame([([("human", "hi"), ("gpt", "yo")],)], "conversations array<struct<from:string,value:string>>")) == [[("user", "hi"), ("assistant", "yo")]]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))
    mixed = ['{"prompt": "a", "response": "b"}', '{"messages": [{"role": "user", "content": "c"}]}', '{"instruction": "d", "input": "e", "output": "f"}', '{"z": 1}', "no json", None]
    got = chat.canonical_json(spark.createDataFrame([(k, m) for k, m in enumerate(mixed)], "i int, j string"), "j").orderBy("i").collect()
    assert [r["layout"] for r in got] == ["prompt", "messages", "instruction", None, None, None]
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "d"), ("user", "e"), ("assistant", "f")]
    deep = ['{"messages": [{"meta": {"a": [1, {"b": 2}]}, "role": "user", "content": "c"}, {"role": "assistant", "content": "[x] {y}"}], "z": [[{}]]}']
    deep += ['{"instruction": "d", "output": "f"}', '{"prompt": "a", "response": "b", "completion": "c"}', '{"Prompt": "a", "RESPONSE": null}']
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(deep)), "i int, j string"), "j").orderBy("i").collect()
    assert [r["layout"] for r in got] == ["messages", "instruction", None, "prompt"]
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "c"), ("assistant", "[x] {y}")] and [tuple(t) for t in got[1]["turns"]] == [("user", "d"), ("assistant", "f")]


def test_the_fingerprint_selects_the_layout(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "b", "c")], "prompt string, response string, completion string")
    with pytest.raises(ValueError):  # two layouts fit: neither field may be lost
        chat.canonical_turns(rows)
    assert chat.select_layout(rows.drop("completion")).name == "prompt" and chat.select_layout(rows.drop("response")).name == "completion"
    assert chat.select_layout(rows.drop("response").withColumn("input", F.lit(1)).withColumn("zz", F.lit(1))).name == "completion"
    assert chat.select_layout(spark.createDataFrame([("a", "b")], "instruction string, output string")).name == "instruction"
    # Shapes that hold all of another layout are told apart by the fingerprint alone.
    both = (chat.Layout("small", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))), chat.Layout("large", ("completion", "prompt", "response"), turns=(("user", "prompt"), ("assistant", "completion"))))
    assert chat.select_layout(rows, both).name == "large" and chat.select_layout(rows.drop("completion"), both).name == "small"
    monkeypatch.setattr(chat, "fingerprint", lambda paths: F.xxhash64(F.lit("x"), F.rand(), F.size(paths)))
    with pytest.raises(ValueError):
        chat.select_layout(rows, both)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, None, "user", "z"), (2, 0, "assistant", "long " * 200000), (2, 0, "assistant", "long " * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.render(chat.canonical_turns(df)).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert got[None]["loss"] == "y" and got[1]["loss"] == "" and got[2]["loss"] == "long " * 400000


# the queries


def test_queries_over_the_small_tables(spark, sf):
    import __spark_entry__ as entry

    queries = entry.queries()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_toxicity", "op4_pii", "op5_language_id", "op6_bpe", "op7_lm_score", "op8_suffix_dedup", "op9_ngram_join"):
        assert queries[name](spark, sf).count() == n, name
    held = {r["doc_id"]: r["held_out"] for r in queries["op5_language_id"](spark, sf).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage over odd rows beside the small table: what goes, what changes, and what the last one counts."""
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    odd = [(-1, None), (-2, ""), (-3, "123 !?"), (-4, item), (-5, item.upper() + " and more"), (-6, "mail me at someone.here@mail1.example.com now"), (None, table.first()["text"]), (-7, "word " * 30000)]
    extra = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in odd], table.schema)
    docs = table.union(extra).union(table.limit(3)).withColumn("score", F.lit("kept"))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"] if r["doc_id"] is not None else 10**9, r["text"] or "") for r in df.collect()))
    # language: the same decision, text by text.
    out = common.materialize(stages["language"](spark, docs, sf))
    known = langid.Classifier(langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True)))
    assert rows(out) == sorted(x for x in rows(docs) if not known.classify(x[1])[2]) and out.columns == docs.columns
    gone = {x[0] for x in rows(docs)} - {x[0] for x in rows(out)}
    assert {-1, -2, -3} <= gone
    # near duplicates: one of each component by brute force, and rows without an id.
    docs = out.drop("score")
    out = common.materialize(stages["near_duplicates"](spark, docs, sf))
    groups = brute_components([(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()], 5, 80)
    assert rows(out) == sorted({x for x in rows(docs) if x[0] == 10**9 or groups[x[0]][1] == x[0]})
    # benchmark: every document against every item by plain tiling, where enough windows are shared.
    docs = out
    out = common.materialize(stages["benchmark"](spark, docs, sf))
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = [{tuple(i[k : k + 3]) for k in range(len(i) - 2)} for i in items]

    def held(text):
        ws = words_of(text)
        mine = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
        for i, w in zip(items, windows, strict=True):
            if 3 * len(w & mine) >= 0.8 * len(i) - 1e-9:
                known = set(i)
                short = [x if x in known else None for x in ws]
                if sum(k for *_, k in brute_tiles([x for k, x in enumerate(short) if x or (k and short[k - 1])], i)) >= 0.8 * len(i) - 1e-9:
                    return True
        return False

    assert rows(out) == [x for x in rows(docs) if not held(x[1])] and not {-4, -5} & {x[0] for x in rows(out)}
    # personal data: the base spans' places are hidden, texts without a span are as they were.
    docs = out
    out = common.materialize(stages["personal_data"](spark, docs, sf))
    model = pii.fit(docs.select("doc_id", "text"))
    want = []
    for i, t in rows(docs):
        base = brute_spans(t)
        spans = sorted(base + model.added(t, base))
        want.append((i, pii.hide(t, spans) if spans else t))
    assert rows(out) == sorted(want) and any("[EMAIL]" in t for _, t in want)
    # encode: counts and digests by the library.
    lib = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    lib.no_truncation()
    lib.no_padding()
    got = {(r["doc_id"] if r["doc_id"] is not None else 10**9): (r["n_tokens"], r["ids_sha256"]) for r in stages["encode"](spark, out, sf).collect()}
    for i, t in rows(out):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pipeline_keeps_clean_documents_and_applies_each_stage(spark, tmp_path):
    import shutil

    import corpus_pipeline

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("hits", F.lit("kept")).withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, str(tmp_path / "sf")))
        assert out.columns == docs.columns and out.where("hits <> 'kept'").count() == 0, name
        assert 0.7 * docs.count() < out.count() <= docs.count()
        docs = out
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = brute_components(texts, 5, 80)
    assert all(d == c for d, (_, c) in found.items())
    assert not any(brute_spans(t or "") for _, t in texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "sf")).count() == len(texts)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "sf")).count() == 0
