"""Fill-in-middle, hard negatives and ORC token files against brute force, with nulls, ties, repeats and empty tables."""

import gc
import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest

from hearthlog.llm import common, fim, hard_negatives, packing, token_orc
from hearthlog.llm.queries import QUERIES
from hearthlog.llm.token_ids import IdCache
from pyspark.sql import functions as F

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "é", "漢", "\U0001f600́x", "has <P> in it", "<S", "ends with <", "<M>", "ab" * 3000, "é漢\U0001f600 " * 700, "\x00\r\n\t", "plain words, and more of them. don't I'll 12345 ?!", "<|endoftext|> twice <|endoftext|>"]
SCHEMA = "doc_id long, text string, n int, form string, part int, before long, uid string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2, 3, "u") for i, t in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    more = ["".join(rnd.choice("ab é漢<>PSM\U0001f600\n") for _ in range(rnd.randrange(300))) for _ in range(150)]
    words = ["".join(rnd.choice("abcdefghéü") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    more += [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", "!?)", "'s", ";;;"]) for _ in range(100)) for _ in range(40)]
    return list(enumerate(TEXTS + more)) + [(7, "same id, another text"), (14, TEXTS[14]), (14, TEXTS[14]), (None, "no id"), (None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_fim(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, sha(t), sha(t))
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if h4 % 100 < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return (doc_id, len(t), "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(t))


def test_op11_matches_slices_of_code_points(spark, rows):
    made = fim.transform(table(spark, rows))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fim.restored(F.col("output"), F.col("form")), 256))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected_fim(*r) for r in rows), key=str)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    assert fim.transform(table(spark, []).limit(0)).count() == 0


def test_op11_rank_and_select_are_inverse():
    rnd = np.random.default_rng(2)
    for size in (0, 1, 7, 8, 511, 512, 513, 5000):
        bits = rnd.random(size) < 0.3
        v, ones = fim.BitVector(bits), np.flatnonzero(bits)
        assert v.total == len(ones)
        assert (v.rank(np.arange(size + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (v.select(np.arange(len(ones) + 2)) == [*ones, size, size]).all()


def brute_negatives(rows, every=50, k=5, m=3):
    """rows: (id, vector, label) in any order."""
    sound = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i)
    out = []
    for a, (anchor, v, y) in enumerate(sound):
        if anchor is None or anchor % every:
            continue
        scored = [(dot(v, w), i, z) for b, (i, w, z) in enumerate(sound) if b != a]
        best = lambda some, n: sorted(some, key=lambda s: (-s[0], last(s[1])))[:n]
        for ps, p, _ in best([s for s in scored if s[2] == y], k):
            fits = [s for s in scored if s[2] != y and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(anchor, p, n, i, ps, s) for n, (s, i, _) in enumerate(best(fits, m), 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, uid string, part int, place int"


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "u", 1, 2) for i, v, y in rows], VECTORS).repartition(3)
    out = hard_negatives.mine(df, **more)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(n, width, labels, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, width))
    kinds = rnd.integers(0, labels, n)
    return [(i, [float(np.float32(x)) for x in (centres[y] + rnd.normal(size=width)) / 4], int(y)) for i, y in enumerate(kinds)]


def test_op12_matches_brute_force(spark):
    rows = vectors(900, 6, 4, 1)
    one = rows[3][1]
    rows += [(1000 + k, one, k % 3) for k in range(40)]  # equal vectors: ties by id
    rows += [(2000, None, 1), (2001, [None, 1.0], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 1), (2004, one, None), (2050, [], 2), (2051, [0.5, 0.5], 2), (None, rows[50][1], 2), (50, rows[50][1], rows[50][2]), (50, rows[51][1], 0)]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, tree_rows=150, block_rows=5) == want  # many trees and blocks


def test_op12_large_numbers_and_few_rows(spark):
    rows = [(0, [3e20, 1.0], 1), (1, [2e-20, 5.0], 1), (2, [1e-20, 1.0], 2), (3, [1.2e-20, 2.0], 3), (50, [0.0, 0.0], 1)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, []) == []


def test_op12_prunes_what_cannot_be_among_the_best():
    rnd = np.random.default_rng(4)
    rows = np.floor(256 * (rnd.normal(size=(20, 1, 3)) * 5 + rnd.normal(size=(20, 400, 3)) / 9).reshape(-1, 3))
    labels = rnd.integers(0, 2, len(rows))
    tree = hard_negatives.BallTree.build(rows, labels, np.arange(len(rows)), np.arange(len(rows)))
    again = hard_negatives.BallTree.loads(tree.dumps())
    q = hard_negatives.Queries(rows[:3], np.arange(3), labels[:3], np.arange(3), True, 5)
    again.search(q)
    for a in range(3):
        scores = [(-int(rows[a] @ rows[b]), b) for b in range(len(rows)) if b != a and labels[b] == labels[a]]
        assert [(-s, b) for s, b in sorted(scores)[:5]] == list(zip(q.best[a].tolist(), q.ids[a].tolist()))
    assert q.pruned > q.seen / 4


def reference_ids(texts, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_segments_give_the_ids_of_the_library(rows):
    texts = [t or "" for _, t in rows] + [" two", "x,", "x.)!?;", " ,", "a b", "ǅungla ΩΩ, ÿ! ÷×", "Don't.", "it's", " ab.\nCd,", "ab\ncd", "ab\n cd", "ab \ncd", "a\n\nb", "x$$$ y&&&\n#z ~w~\nöß>> a's,\nt"]
    for most in (64_000_000, 0):
        got = [np.frombuffer(x, "<u4").tolist() + [2] for x in IdCache(TOKENS, most).encode(texts)]
        assert got == reference_ids(texts)


def test_op13_files_hold_the_ids_in_order(spark, rows, tmp_path):
    docs = table(spark, rows)
    token_orc.write(docs, str(tmp_path / "t"), TOKENS, partitions=5)
    got = sorted(map(tuple, token_orc.digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    ids = {}
    for (i, _), x in zip(rows, reference_ids([t for _, t in rows])):
        ids.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for i, begin, n, crc in got:
        assert begin == start
        ids[i].remove((n, crc))
        start += n
    assert not any(ids.values())
    # every file is in order, and later files have no smaller ids
    files = sorted((tmp_path / "t").glob("part-*.orc"))
    held = [i for f in files for i in orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist()]
    assert held == [r[0] for r in got]
    assert token_orc.round_trip(table(spark, []).limit(0), TOKENS).count() == 0


def test_op13_reads_by_stripe_and_skips_by_index_and_bloom_filter(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), k -> hash(id * k))) AS text")
    token_orc.write(docs, str(tmp_path / "t"), TOKENS, partitions=1, stripe_bytes=200_000, row_stride=1000)
    (file,) = (tmp_path / "t").glob("part-*.orc")
    assert orc.ORCFile(file).nstripes > 2
    stored = token_orc.read(spark, str(tmp_path / "t"))
    assert stored.filter("doc_id = 777").count() == 0 and stored.filter("doc_id = 776").count() == 1
    plan = stored.filter("doc_id = 776").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,776)]" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan


def test_a_hot_id_is_dealt_over_files(spark, tmp_path):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 5, id) AS doc_id", "concat('text ', id) AS text")
    token_orc.write(docs, str(tmp_path / "t"), TOKENS, partitions=8)
    assert token_orc.read(spark, str(tmp_path / "t")).filter("doc_id = 5").select("part").distinct().count() > 1
    got = sorted(map(tuple, token_orc.digests(spark, str(tmp_path / "t")).select("start", "n_tokens").collect()))
    assert [a for a, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()]


def test_queries_of_the_three_are_registered():
    assert {"op11_fill_in_middle", "op12_hard_negatives", "op13_token_orc"} <= QUERIES.keys()
    assert packing.id_cache(TOKENS) is packing.id_cache(TOKENS)


def test_a_worker_keeps_nothing_for_other_operators():
    """Segments of packing stayed in workers beside what the stages of the next run need."""

    def run(batches):
        yield from batches

    kept = weakref.ref(packing.id_cache(TOKENS))
    assert list(common.lean(run, (TOKENS, 96_000_000))([1, 2])) == [1, 2]
    assert kept() is not None
    assert list(common.lean(run)([1, 2])) == [1, 2]
    gc.collect()
    assert kept() is None

    less = weakref.ref(packing.id_cache(TOKENS, 1_000_000))
    packing.id_cache(TOKENS)
    gc.collect()
    assert less() is None


def test_the_pipeline_packs_with_few_segments_a_worker(spark, rows, monkeypatch):
    import corpus_pipeline

    asked, made = [], packing.cut_pieces
    monkeypatch.setattr(packing, "cut_pieces", lambda *a, **b: (asked.append(a[-1]), made(*a, **b))[1])
    docs = table(spark, rows)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, whole = (sorted(map(str, x.select(columns).collect())) for x in (corpus_pipeline.pack(spark, docs, ""), packing.pack_documents(docs, TOKENS)))
    assert got == whole
    assert asked[0] <= 32_000_000 < asked[1]


def best_fit_alone(counts, capacity):
    """Sequences of best fit, longest first, one piece at a time."""
    room = np.zeros(capacity + 1, np.int64)
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = next((r for r in range(length, capacity + 1) if room[r]), None)
            if at is None:
                room[capacity - length] += 1
            else:
                room[at] -= 1
                room[at - length] += 1
    return int(room.sum())


@pytest.mark.parametrize("lengths", [range(1, 65), range(12, 44), [40, 30, 24, 20, 10, 4], [33, 31, 17, 16, 15]])
def test_op7_never_needs_more_than_best_fit(lengths):
    rnd = random.Random(8)
    for _ in range(20):
        counts = {n: rnd.randrange(0, 12) for n in lengths}
        found = packing.plan(counts, 64)
        used = {}
        for times, members in found:
            assert sum(members) <= 64
            for m in members:
                used[m] = used.get(m, 0) + times
        assert used == {k: v for k, v in counts.items() if v}
        assert sum(times for times, _ in found) <= best_fit_alone(counts, 64)


def test_op3_texts_of_one_id_with_equal_checksums(spark):
    """Two texts of one id whose short checksums agree are still two documents, in the order of their digests."""
    from hearthlog.llm import suffix_dedup

    rnd = random.Random(6)
    say = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = say(150)
    one = say(200) + shared + say(50)
    two = next(t for t in (f"{k:07}" + say(40) + shared + say(60) for k in range(10**6)) if zlib.crc32(t.encode()) & 0x7FFF == zlib.crc32(one.encode()) & 0x7FFF)
    rows = [(3, shared[:120] + "zz"), (5, one), (5, two), (5, two), (9, say(300)), (9, None), (8, two[:200])]
    name = lambda t: sha(t or "")
    apart = sorted({(i, name(t), t or "") for i, t in rows})
    numbered = {(i, n): k for k, (i, n, _) in enumerate(apart)}
    want = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table(spark, [(k, t) for k, (_, _, t) in enumerate(apart)])).collect()}
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    assert got == sorted((i, *want[numbered[i, name(t)]]) for i, t in rows)


def test_fitted_rules_of_thin_corpora(spark):
    """An empty corpus leaves the base rules alone; a language without frequent words changes no other language's limit."""
    from hearthlog.llm import quality_rules

    english = [f"the a{k} cat and the b{k} dog of the c{k} house and a d{k} bird in the e{k} tree" for k in range(300)]
    foreign = [f"q{k}z r{k}z" for k in range(3000)]
    schema = "doc_id long, lang string, text string"
    trusted = lambda rows: quality_rules.fit(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema))
    docs = spark.createDataFrame([(1, "en", " ".join(english[:5])), (2, "xx", " ".join(foreign[:60])), (3, "en", "too short"), (4, "en", None), (5, "en", "")], schema)
    kept = lambda rules: {r["doc_id"] for r in quality_rules.score(docs, rules).filter("kept").collect()}

    nothing = trusted([("en", None), (None, "text")])
    assert not nothing.words and kept(nothing) == {1, 2}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs, nothing).collect()} == {1, 2}
    one, both = trusted([("en", t) for t in english]), trusted([("en", t) for t in english] + [("xx", t) for t in foreign])
    assert kept(one) == {1} and both.words["xx"] == {} and both.most_word_distance == one.most_word_distance > 0 and kept(both) == {1, 2}


def test_words_are_encoded_as_the_library_does():
    """Plain words skip the pattern and the mapping of bytes; ids stay those of Tokenizer.encode."""
    import public_tokenizers

    from hearthlog.llm.token_ids import IdCache

    of = IdCache(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["word", "Word,", "a\nb", "x.\nY!", "été", "Ärger,", "don't", "I'll", "x1", "1", "_a", "ſ", "a²", "a\n", "\na", "!!!", "漢字", "Ġ", "Ċ", "q\u00a0r", " lead", "trail ", " ", ""]
    texts = [*words, *[f"so {w} on" for w in words], " ".join(words), "  ".join(words)]
    assert list(of.encode(texts)) == [of._encode(t) for t in texts]
    seen = []
    of.WORD = type("Asked", (), {"fullmatch": lambda self, s: seen.append(s)})()
    assert list(of.encode(["plainword otherword"])) == [of._encode("plainword otherword")] and seen == []
