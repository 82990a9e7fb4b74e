"""Each operator against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hearthlog.llm import bpe, chat, exact_dedup, ngram_join, packing, pii, quality_classifier, quality_rules, suffix_dedup, toxicity
from hearthlog.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, n int, uid string, node long, token string, z string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "u", 5, "t", "z") for i, t in rows], SCHEMA)


def corpus(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = say(60)
    texts = [None, "", " \t\n", "One", "one", "a b c d", "A B C d", say(40), shared, shared.upper(), shared + " tail", say(20) + " " + shared + " " + say(20), say(3000), "x" * 5000, "é漢字 " * 50, "l1 a\nl1 a\n\nl2", say(30) + "\n" + say(30)]
    for _ in range(6):  # near copies
        w = shared.split()
        w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return list(enumerate(texts)) + [(7, texts[7]), (None, "null id text with enough words in it"), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_every_operator_takes_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (
        bpe.encode_decode(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), quality_rules.score(none), quality_rules.keep_good(none), suffix_dedup.remove_repeats(none),
        ngram_join.link_components(none), ngram_join.keep_one(none), quality_classifier.classify(none, labels), toxicity.grade(none, labels), packing.pack_documents(none, path), chat.format_chats(turns),
        pii.find(none), pii.sanitise(none), exact_dedup.exact_groups(none), exact_dedup.drop_copies(none),
    ):
        assert out.count() == 0


def test_op1_matches_tiktoken(spark, docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(100, "  two  spaces\t\ttabs \n\n lines\x1c\x1d wide\xa0space don't I'LL 12345 ?!?! \U0001f600\U0001f468‍\U0001f469"), (101, " lead"), (102, "trail "), (103, "a\x00b <unk> <s> ▁x"), (104, "İﬁ é")]
    rnd = random.Random(1)
    extra += [(200 + i, "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FF), 10, 32, 32, rnd.randrange(0x3000, 0x9FFF)])) for _ in range(200))) for i in range(20)]
    coded = bpe.encode_decode(docs.unionByName(table(spark, extra)), path, public_tokenizers.PATTERN, ids=True)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded.collect())
    want = Counter()
    for i, t in rows + extra:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(coded.filter("doc_id >= 100"), path, public_tokenizers.PATTERN).collect()}
    assert back == dict(extra)


def test_op2_counts(docs, rows):
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines, dup, met = t.split("\n"), 0, set()
        for x in lines:
            if WORD.search(x):
                dup += x in met
                met.add(x)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    got = quality_rules.score(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert got.filter("kept AND base_failed").count() == 0
    assert Counter(r["doc_id"] for r in quality_rules.keep_good(docs).collect()) == Counter(r["doc_id"] for r in got.filter("kept").collect())


def test_op2_divergence():
    prose = "The house of the old man was on the hill, and it had a view of the sea. " * 2 + "In the morning he went to the shore with his dog for a walk, as it is with men at that age."
    odd = "### @@@ $$$ %%% ^^^ &&& *** ((( ))) +++ === {{{ }}} [[[ ]]] ||| ~~~ ``` <<< >>> " * 4
    a, b = quality_rules.measure([prose, odd], quality_rules.Rules())
    assert a[5] < 0.15 < 0.6 < b[5] and a[6] < 0.4 and quality_rules.verdict(len(odd), b, quality_rules.Rules()) is False
    one = np.array([[1.0, 1.0]])
    assert quality_rules.distance(one, np.array([0.5, 0.5]))[0] == 0 and abs(quality_rules.distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] - 1) < 1e-12


def test_op2_rejects_texts_without_common_words():
    rnd, rules = random.Random(6), quality_rules.Rules()
    content = lambda n: [("".join(rnd.choice("bdfghklmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 5)))) for _ in range(n)]
    menu = lambda n: " | ".join(" ".join(content(2)) for _ in range(n))
    for text in (menu(30), menu(1200), " ".join(content(300))):
        m = quality_rules.measure([text], rules)[0]
        assert m[0] >= rules.least_words and m[5] <= rules.most_char_distance and not quality_rules.verdict(len(text), m, rules)
    for lang, words in rules.words.items():
        q = np.array([*words.values(), 1 - sum(words.values())])
        assert quality_rules.distance(np.array([[0.0] * len(words) + [1.0]]), q)[0] > rules.most_word_distance, lang
        prose = [w for w, share in words.items() for _ in range(round(100 * share))] * 2
        prose += content(200 - len(prose))
        rnd.shuffle(prose)
        text = " ".join(prose) + "."
        assert quality_rules.verdict(len(text), quality_rules.measure([text], rules)[0], rules), lang


def brute_repeats(docs, length):
    seen, out = set(), {}
    for key, data in sorted(docs):
        bits = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                bits[i : i + length] = True
            seen.add(s)
        out[key] = bits
    return out


@pytest.mark.parametrize("seed", range(3))
def test_op3_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rule = suffix_dedup.Repeats(length=20, gram=6, run=30)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randint(10, 90))) for _ in range(5)]
    made = [(i, "".join(rnd.choice([rnd.choice(pieces), "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 7)))) for i in range(40)]
    made += [(50, None), (51, ""), (52, "x" * 300), (None, pieces[0] * 2), (53, "".join(rnd.choice("abcdefgh") for _ in range(3000))), (7, made[7][1])]
    got = suffix_dedup.remove_repeats(table(spark, made).repartition(6), rule, keep_text=True).collect()
    bits = brute_repeats({(-1 if i is None else i, (t or "").encode()) for i, t in made}, 20)
    assert len(got) == len(made)
    for r in got:
        i = -1 if r["doc_id"] is None else r["doc_id"]
        data = ("" if i == 50 else dict((-1 if k is None else k, t) for k, t in made)[i] or "").encode()
        gone = bits[i][: len(data)]
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        n = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(data), int(gone.sum()), n, kept)


def test_op3_slices_of_long_texts():
    rule, rnd = suffix_dedup.Repeats(length=20, gram=6), random.Random(9)
    data = np.frombuffer(bytes(rnd.choice(b"abc") for _ in range(2000)), np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([data.tobytes().decode()]), pa.array([0])], names=["doc", "text", "no"])
    whole, sliced = ({(x["h"], x["at"], x["stop"]) for b in suffix_dedup._find_anchors(rule, chunk=c)([batch]) for x in b.to_pylist() if x["stop"] < 0} for c in (10**6, 100))
    assert whole == sliced


def test_op3_merge_is_a_merge():
    rnd = random.Random(4)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randint(0, 30))) for _ in range(7)]
    share = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    shared = [[0, *[share(a, b) for a, b in zip(r, r[1:])]][: len(r)] for r in runs]
    which, at, lcp = suffix_dedup.merge_runs(runs, shared, 12)
    out = [runs[w][i] for w, i in zip(which, at)]
    assert out == sorted(x for r in runs for x in r) and list(lcp[1:]) == [share(a, b) for a, b in zip(out, out[1:])]


@pytest.mark.parametrize("frequent", [50, 3])
def test_op4_matches_brute_force(spark, docs, rows, frequent):
    rule = ngram_join.Join(frequent=frequent)
    keyed = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in keyed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in keyed:
        for j, b in keyed:
            if i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    want = Counter((i, len(s), root(i)) for i, s in keyed)
    for i, t in rows:
        if i is None:
            want[None, len(shingles(t)), None] += 1
    assert Counter(tuple(r) for r in ngram_join.link_components(docs, rule).collect()) == want
    kept = ngram_join.keep_one(docs, rule)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NOT NULL").select("doc_id").distinct().count() == len({root(i) for i, _ in keyed})


def test_op4_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    made = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]  # each links with its neighbours only
    got = ngram_join.link_components(table(spark, made)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_op4_components_converge_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["comp"] for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, most_rounds=1)


def test_op5_learns(spark):
    rnd = random.Random(2)
    good, bad = ["house", "river", "walk", "green", "stone"], ["h0use$$$", "win!!!", "cl1ck***", "fr33%%%"]
    made = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(rnd.randint(5, 60)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i, _ in made] + [(9999, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, made + [(1000, None), (1001, ""), (1002, "house " * 3000)])
    out = quality_classifier.classify(docs, labels, quality_classifier.Training(sample=200, buckets=1 << 14)).collect()
    assert len(out) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(bool(r["doc_id"] % 3)) for r in held]) > 0.97
    assert {r["score"] for r in quality_classifier.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_op5_reads_long_words_whole():
    t = quality_classifier.Training(buckets=1 << 14)
    rnd = random.Random(8)
    word = "".join(rnd.choice("漢字語文学生日本") for _ in range(400)).encode()
    features = quality_classifier.Features(t)
    whole = b"<" + word + b">"
    want = Counter([zlib.crc32(word, 1) % t.buckets] + [zlib.crc32(whole[i : i + n]) % t.buckets for n in (3, 4) for i in range(len(whole) - n + 1)])
    assert all(Counter(np.concatenate(list(features.of_long_word(word, most))).tolist()) == want for most in (7, 100, 1 << 18)) and Counter(features.of_word(word)) == want
    good, bad = "花鳥風月山川" * 60, "買賣錢金銀銅" * 60
    start = "漢字" * 60
    model = quality_classifier.Model(t).train([start + good, start + bad] * 20, [1, 0] * 20)
    scorer = quality_classifier.Scorer(t, *model.flat())
    # Words that no training text held, equal in their first 360 bytes: only n-grams behind those tell them apart.
    a, b = scorer([start + good + "山川", start + bad + "銀銅"])
    assert a > 0.7 > 0.3 > b and not scorer.words.number
    weights, buckets = model.flat()[0].astype(float), features.of_word((start + good).encode())
    assert abs(scorer([start + good])[0] - 1 / (1 + np.exp(-(model.flat()[1] + weights[buckets].mean())))) < 1e-9


def test_op2_fits_references(spark):
    made = [("x", "Aa bb, bb #é 1"), ("x", "bb cc"), ("y", "dd dd dd ee"), (None, "zz"), ("y", None)]
    rules = quality_rules.fit(spark.createDataFrame(made, "lang string, text string"), least_share=0.2)
    assert rules.words == {"x": {"bb": 3 / 7}, "y": {"dd": 3 / 4, "ee": 1 / 4}}
    text = "Aa bb, bb #é 1" + "bb cc"
    want = Counter("upper" if c.isupper() else "lower" if c in string.ascii_lowercase else "digit" if c.isdigit() else "space" if c == " " else "stop" if c == "," else "symbol" if c == "#" else "wide" for c in text)
    assert rules.characters["x"] == tuple(want[c] / len(text) for c in quality_rules.CLASSES)
    assert 0 < rules.most_word_distance <= 1
    assert quality_rules.fit(spark.createDataFrame([], "lang string, text string")).words == {}
    # The rules of a corpus judge by its words.
    judged = quality_rules.score(table(spark, [(1, "dd dd ee dd dd ee dd " * 3), (2, "qq rr ss tt uu " * 10)]), quality_rules.Rules(characters=rules.characters, words=rules.words, least_chars=10**6, most_word_distance=0.5)).collect()
    assert len(judged) == 2


def test_op5_matches_plain_average_and_softmax(spark):
    """Scores against a plain loop: the mean of the features' vectors, the linear layer and softmax."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    made = [(i, " ".join(rnd.choice(words[:25] if i % 2 else words[15:]) for _ in range(rnd.randint(1, 30)))) for i in range(80)] + [(200, None), (201, "unseen wörd " + "x" * 500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    docs, t = table(spark, made), quality_classifier.Training(buckets=1 << 12)
    rows = quality_classifier.sample(docs, labels, "quality", t.sample)
    model = quality_classifier.Model(t).train([r[1] for r in rows], [r[2] for r in rows])
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels, t).collect()}
    for i, text in made:
        tokens, buckets = (text or "").encode().split(), []
        for w in tokens:
            whole = b"<" + w + b">"
            buckets += [zlib.crc32(w, 1) % t.buckets] + [zlib.crc32(whole[k : k + n]) % t.buckets for n in range(t.least_chars, t.most_chars + 1) for k in range(len(whole) - n + 1)]
        if len(tokens) > 1:
            buckets += model.features.of_pairs(np.array([zlib.crc32(w) for w in tokens], np.uint64)).tolist()
        h = np.mean([model.E[b].astype(float) for b in buckets], axis=0) if buckets else np.zeros(t.dims)
        z = h @ model.W + model.b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(out[i]["score"] - p[1]) < 1e-5 and out[i]["predicted"] == int(out[i]["score"] >= 0.7)


def test_op5_op6_sample_holds_one_row_for_each_id(spark):
    docs = table(spark, [(3, f"text {i:03d}") for i in range(300)] + [(i, f"doc {i}") for i in range(4, 60)] + [(3, None)] * 2).repartition(7)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    for label, even in (("quality", False), ("toxic", True)):
        rows = quality_classifier.sample(docs, labels, label, 1000, even=even)
        assert [r[0] for r in rows] == [i for i in range(3, 60) if zlib.crc32(str(i).encode()) % 4 != 2]
        assert all(r == (r[0], f"doc {r[0]}" if r[0] > 3 else "", r[0] % 2) for r in rows)
    assert len(quality_classifier.sample(docs.filter("doc_id = 3"), labels, "quality", 5)) <= 5


def test_op6_orders_severity(spark):
    rnd = random.Random(5)
    plain, rude = [f"{a}{b}" for a in ("lake", "tree", "road", "song") for b in ("", "s", "land", "side")], ["zorgling", "zorgled", "brakh", "brakhs"]

    def text(n):
        return " ".join([rnd.choice(plain) for _ in range(60)] + [rnd.choice(rude) for _ in range(n)])

    made = [(i, text(i % 4 * 3 if i % 2 else 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(bool(i % 2 and i % 4))) for i, _ in made], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.grade(table(spark, made + [(1000, None), (1001, text(1)), (1002, text(12))]), labels).collect()}
    held = [i for i, _ in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["toxic"] == int(bool(i % 2 and i % 4)) for i in held)
    assert out[1000]["toxic"] == 0 and out[1001]["severity"] < out[1002]["severity"] <= 3
    assert {r["toxic"] for r in toxicity.grade(table(spark, made[:5]), labels.limit(0)).collect()} == {0}


def test_op7_packs_exactly(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    extra = [(300, "say <|endoftext|> now"), (301, " \n x  y"), *[(400 + i, "word " * i) for i in range(1, 200)]]
    out = [r.asDict() for r in packing.pack_documents(docs.unionByName(table(spark, extra)), path).collect()]
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want, total = Counter(), 0
    for i, t in rows + extra:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids), 1024), len(ids)]
        total += len(ids)
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert got == want
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= -(-total // 1024) + 2


@pytest.mark.parametrize("seed", range(5))
def test_op7_plan_uses_each_length_as_often_as_it_occurs(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.randint(1, 64) for _ in range(rnd.choice([1, 50, 2000])))
    used = Counter()
    for times, members in packing.plan(counts, 64):
        assert times > 0 and sum(members) <= 64
        for m in members:
            used[m] += times
    assert used == counts


def test_op8_keeps_maximal_conversations(spark):
    def say(c, *texts, **k):
        return [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    made = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "x") + say(4, "a", "b", "c") + say(5, "a") + say(6, None, "b") + [(7, 0, None, "a"), (8, 5, "user", "tie"), (8, 5, "user", "tie"), (None, 0, "user", "alone"), (None, 1, "user", "alone"), (9, None, "user", "z")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in made], "conv_id long, turn long, role string, text string, place int, key int").repartition(3)
    out = {(r["conv_id"], r["n_turns"], r["copies"]): r["rendered"] for r in chat.format_chats(turns).collect()}
    assert set(out) == {(2, 3, 2), (3, 2, 1), (6, 2, 1), (7, 1, 1), (8, 2, 1), (None, 1, 2), (9, 1, 1)}
    assert out[3, 2, 1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n" and "unknown" in out[7, 1, 1]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_op9_base_spans(seed):
    rnd = random.Random(seed)
    parts = ["a@b.co", "x..y@z-.q.r", "@", "a@", ".", "1.2.3.4", "999.1.1.1", "001.02.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49 30 1234", "é", " ", "12", "a@b@c.de", "+", "-", "5500000000000004"]
    for _ in range(500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_op9_is_linear_on_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(t)


def test_op9_adds_disclosing_terms(spark):
    made = [(i, f"nice {'aeiou'[i]}day of kormoran sees bob@x.example.org near {'aeiou'[i]}house end") for i in range(5)]
    made += [(10 + i, f"plain words of day number{'x' * i} here") for i in range(200)] + [(300, None), (301, ""), (302, "mail bob@x.example.org kormoran kormoran"), (302, "mail bob@x.example.org kormoran kormoran"), (None, "call +1 555 123 4567 8 now")]
    docs = table(spark, made)
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == len(made)
    assert "term" in out[0]["spans"] and "kormoran" not in out[0]["text"] and "[EMAIL]" in out[0]["text"] and "nice" not in out[0]["text"].split("[EMAIL]")[1]
    assert out[12]["spans"] == "" and out[12]["text"] == made[7][1] and out[300]["text"] == "" and out[None]["n_phone"] == 1
    assert out[302]["spans"].count("term") == 2 and out[302]["base_sha256"] == hashlib.sha256(b"email:5:22").hexdigest()
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(made) and clean.filter("text LIKE '%@%'").count() == 0 and clean.filter("text IS NULL").count() == 1


def kinds_corpus(n=400):
    """Documents in which the word `badge` comes with card numbers, and other words don't."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    made = []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(12)) + f" number{'x' * (i % 7)}{'y' * (i // 7)}"
        if i % 10 == 0:
            text += " badge" + (" 4111 1111 1111 1111" if i % 30 else " is here")
        made.append((i, text))
    return made


@pytest.mark.parametrize("most", [pii.MOST_TOLD, 0])
def test_op9_matches_brute_force(spark, monkeypatch, most):
    """Terms of kinds and entities, by the sent-around table and by the join, against plain counts."""
    monkeypatch.setattr(pii, "MOST_TOLD", most)
    made, rule = kinds_corpus(), pii.Disclosure(least_contexts=10**9)
    texts = sorted({t for _, t in made})
    n, both, own, total = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        half, base = zlib.crc32(t.encode()) & 1, brute_spans(t)
        total[half] += 1
        bare = t
        for a, _, b in sorted(base, reverse=True):
            bare = bare[:a] + "#" * (b - a) + bare[b:]
        terms, kinds = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", bare)}, {k for _, k, _ in base}
        n.update((w, half) for w in terms)
        own.update((k, half) for k in kinds)
        both.update((k, w, half) for k in kinds for w in terms)
    good = lambda k, w, h: both[k, w, h] >= rule.least_documents and np.log2(both[k, w, h] / n[w, h] / (own[k, h] / total[h])) >= -np.log2(own[k, h] / total[h]) * rule.least_share
    want = {(pii.KINDS[k], w) for k, w, _ in both if all(good(k, w, h) for h in (0, 1))}
    assert want == {("card", "badge")}
    docs = table(spark, made * 2).repartition(5)
    assert {(r["entity"], r["term"]) for r in pii.disclosing_terms(docs, rule).collect()} == want
    spans = {r["doc_id"]: r for r in pii.find(docs, rule).collect()}
    for i, t in made:
        base = brute_spans(t)
        terms = [(m.start(), 4, m.end()) for m in re.finditer("badge", t)] if base else []
        written = lambda x: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
        assert spans[i]["spans"] == written(base + terms) and spans[i]["n_card"] == sum(k == 2 for _, k, _ in base)
        assert spans[i]["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()


def test_op9_is_linear_in_entities():
    text = " ".join(f"word{'abc'[i % 3]} me{i}@x.example.org" for i in range(10_000))
    spans = pii.base_spans(text)
    assert len(spans) == 10_000 and len(pii.free_terms(text, spans)) == 10_000
    import pyarrow as pa

    rows = [b.num_rows for b in pii._met_in(60)([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])]
    assert sum(rows) > 20_000


def test_op9_counts_copies_once(spark):
    made = [(i, f"nice {'aeiou'[i]}day of kormoran sees bob@x.example.org near {'aeiou'[i]}house end") for i in range(5)]
    made += [(1000 + i, f"plain words of day number{'x' * i} here") for i in range(600)] + [(300, None), (302, "mail bob@x.example.org kormoran kormoran"), (303, "call +1 555 123 4567 8 now")]
    line = " and so he wrote to all of the others in the house: kormoran reads bob@x.example.org at the end of each day and of each long night too"
    made += [(400 + i, f"letter {'y' * i}{' far from it' * 9}{line}") for i in range(30)]  # one context in many documents
    spans = lambda rows: {r["doc_id"]: r["spans"] for r in pii.find(table(spark, rows).repartition(6)).collect()}
    want = spans(made)
    assert all(want[i].count("term") >= 1 for i in [*range(5), 302, *range(400, 430)])
    assert spans(made * 3) == want
    assert spans(made + [x for x in made if x[0] == 302] * 40) == want
    assert spans(made + [x for x in made if x[0] == 303] * 300) == want
    told = {r["term"] for r in pii.disclosing_terms(table(spark, made * 3)).collect() if r["entity"] == "email:bob@x.example.org"}
    assert "kormoran" in told


def test_op4_links_all_texts_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    made = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, None), (None, a), (6, "one two"), (7, "one  two"), (7, "One two"), (8, "z")]
    got = ngram_join.link_components(table(spark, made)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (None, None): 1, (6, 6): 1, (7, 6): 2, (8, 8): 1})
    kept = ngram_join.keep_one(table(spark, made)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "6", "8", "None"] and kept[0].asDict().keys() == table(spark, made).first().asDict().keys()


def test_op4_parities_and_packed_sets():
    rnd = np.random.default_rng(1)
    for n, m, common in ((5, 5, 5), (300, 280, 250), (3000, 2500, 2200), (9, 2000, 4)):
        pool = np.unique(rnd.integers(0, 2**48, n + m, np.uint64))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
        assert (ngram_join.unpack_set(ngram_join.pack_set(x)) == x).all()
        p, q = ngram_join.parities(x), ngram_join.parities(y)
        words = min(len(p), len(q))
        differ = np.bitwise_count((ngram_join.folded(p, words) ^ ngram_join.folded(q, words)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(x, y))


def test_op4_long_texts_are_sliced(monkeypatch):
    monkeypatch.setattr(ngram_join.Shingler, "SLICE", 50)
    of = ngram_join.Shingler(5)
    text = " ".join(f"w{i % 37}" for i in range(400)) + "  " + "q" * 300
    sliced = of(text)
    monkeypatch.setattr(ngram_join.Shingler, "SLICE", 10**9)
    assert (sliced == of(text)).all()


def test_op10_reads_survivors_only(spark):
    made = [(1, "Same text"), (2, "same TEXT"), (3, "same tent"), (4, "other"), (2, "same text"), (None, None), (5, "")]
    out = {(r["doc_id"], r["group_size"], r["kept"], r["text_sha256"] is None) for r in exact_dedup.exact_groups(table(spark, made)).collect()}
    assert (4, 1, True, True) in out and (2, 3, True, False) in out and (5, 2, True, False) in out and (None, 2, False, False) in out
    left = exact_dedup.drop_copies(table(spark, made)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("2", "same text"), ("3", "same tent"), ("4", "other"), ("5", "")]


def test_op6_matches_plain_cumulative_links(spark):
    """Severity and grades against plain sums of weights for each threshold."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    made = [(i, " ".join(rnd.choice(words) for _ in range(30)) + " zorgling zorg" * (i % 3)) for i in range(300)] + [(900, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs, t = table(spark, made), toxicity.Training()
    rows = quality_classifier.sample(docs, labels, "toxic", t.sample, even=True)
    model = toxicity.Model(t).fit([r[1] for r in rows], [r[2] for r in rows])
    assert len(model.place) and (np.diff(model.theta) > 0).all()
    out = {r["doc_id"]: r for r in toxicity.grade(docs, labels, t).collect()}
    for i, text in made:
        counts = Counter(f for w in re.findall(r"[^\W\d_]{2,}", (text or "").lower()) for f in toxicity.features(w) if f in model.place)
        eta = sum(model.w[model.place[f]] * np.log1p(n) for f, n in counts.items())
        above = [1 / (1 + np.exp(-(eta - theta))) for theta in model.theta]
        assert abs(out[i]["severity"] - sum(above)) < 1e-6 and out[i]["grade"] == sum(p >= 0.5 for p in above) and out[i]["toxic"] == int(out[i]["grade"] > 0)


def test_op7_index_fills_gaps_exactly():
    index = packing.SumIndex({5: 1, 3: 2, 2: 1}, 16)
    assert index.filling(5, 11) == (5,) and index.filling(8, 8) == (5, 3) and index.filling(10, 6) == (5, 3, 2) and index.filling(9, 7) is None
    assert packing.SumIndex({5: 2}, 10).filling(5, 5) == (5,) and packing.SumIndex({5: 1}, 10).filling(5, 5) is None


def test_op10_matches_brute_force(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = exact_dedup.exact_groups(docs, digest_all=True).collect()
    assert len(out) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_text[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None) and (not r["kept"] or r["doc_id"] == r["keep_id"])
    assert sum(r["kept"] for r in out) == len(groups)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    few = exact_dedup.exact_groups(docs)
    assert few.filter(F.col("text_sha256").isNull() & (F.col("group_size") > 1)).count() == 0
