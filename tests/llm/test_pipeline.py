"""The pipeline's stages against brute force on the smallest documents, and life without the subpackage."""

import ast
import math
import re
import string
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from hearthlog.llm import pii, quality_rules

SF = "/root/testdata/sf0.001"
HOME = Path(__file__).resolve().parents[2]
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        out.append(docs)
    return out


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(stages):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rules = quality_rules.Rules()
    good = {i: t for i, t in docs.items() if quality_rules.verdict(len(t), quality_rules.measure([t], rules)[0], rules)}
    assert kept(stages[0]) == good and len(good) < len(docs)

    last = {}
    for i, t in good.items():
        key = t.translate(FOLD)
        last[key] = max(i, last.get(key, -1))
    once = {i: good[i] for i in last.values()}
    assert kept(stages[1]) == once

    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in once.items() for w in [WORD.findall(t.translate(FOLD))]}
    up = {i: i for i in once}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    one = {i: once[i] for i in ids if root(i) == i}
    assert kept(stages[2]) == one

    clean = kept(stages[3])
    assert clean.keys() == one.keys()
    assert all(not pii.base_spans(t) for t in clean.values()) and all(clean[i] == t for i, t in one.items() if not pii.base_spans(t))

    packed = stages[4].collect()
    assert {r["doc_id"] for r in packed} == one.keys()
    for s in {r["sequence_id"] for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def rejected(text, rules):
    """The quality rules anew, word by word and character by character, for texts of ASCII letters."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    if len(words) < 10 or 100 * len(again) > 20 * len(words):
        return True

    def far(p, references, most):
        def half(a, m):
            return sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)

        total = sum(p)
        p = [x / total for x in p]
        return min(math.sqrt(max(0, (half(p, m) + half(q, m)) / 2)) for q in references for m in [[(x + y) / 2 for x, y in zip(p, q)]]) > most

    kinds = Counter()
    for c in text:
        kinds["lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\x0b\x0c\r" else "stop" if c in quality_rules.STOPS else "symbol" if ord(c) < 128 else "wide"] += 1
    if len(text) >= rules.least_chars and far([kinds[c] for c in quality_rules.CLASSES], list(rules.characters.values()), rules.most_char_distance):
        return True
    plain = Counter(text.translate(FOLD).translate({ord(c): " " for c in quality_rules.STOPS}).split())
    names = sorted({w for ws in rules.words.values() for w in ws})
    found = [plain[w] for w in names]
    return len(words) >= rules.least_words and far([*found, sum(plain.values()) - sum(found)], [[*(ws.get(w, 0) for w in names), 1 - sum(ws.values())] for ws in rules.words.values()], rules.most_word_distance)


GOOD = "it was in the morning that we went to the old harbour and saw how many of the boats had been left there by the men who used to fish for a living on this part of the coast before the winter storms came and took what was not tied down with ropes or chains"
OTHER = "there is no better way to learn about the history of a town than to walk through it with someone who has lived there for all of their life and can say which of the houses were built when and by whom and what became of the people that lived in them after the war"
MENU = " ".join(f"vok{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))
WORDS = GOOD.split()


def letters(k):
    return "".join(chr(97 + int(d) * 2 + j % 2) for j, d in enumerate(f"{k:05d}"))


def strewn(first, n):
    """`n` words of a text with a new word behind every third."""
    words = OTHER.split()
    return " ".join(w for k in range(n) for w in [words[k % len(words)], *([letters(first + k)] if k % 3 == 2 else [])])


def rows_of_run():
    near = " ".join([*WORDS[:-1], "nets"])
    return [
        (1, GOOD), (2, GOOD.replace("the", "The")), (3, near), (4, OTHER), (4, OTHER), (5, None), (6, ""), (7, "   \n\t "), (8, MENU), (9, "too few words"), (10, " ".join(["same words again and again"] * 20)),
        (11, OTHER + " write to ann@example.org about it"), (12, GOOD + " " + OTHER), (None, strewn(0, 60)), (13, GOOD.upper()), (14, strewn(1000, 2500)),
    ]


def test_run(spark, tmp_path):
    """run() over nulls, empty texts, repeated ids and rows: every stage by plain loops, packing by the tokenizer itself."""
    from tokenizers import Tokenizer

    rows = rows_of_run()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "doc_id AS kept", "text AS words").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rules = quality_rules.Rules()
    good = [(i, t) for i, t in rows if t and not rejected(t, rules)]
    assert {i for i, _ in good} == {1, 2, 3, 4, 11, 12, None, 14}
    expected = {}
    for i, t in good:
        key = t.translate(FOLD)
        if key not in expected or (expected[key][0] or -1) < (i or -1):
            expected[key] = (i, t)
    sets = [(i, t, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, t in expected.values() for w in [WORD.findall(t.translate(FOLD))]]
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    linked = [(a[0], b[0]) for k, a in enumerate(sets) for b in sets[:k] if near(a[2], b[2])]
    assert sorted(sorted(p) for p in linked) == [[2, 3], [4, 11]]
    one = {i: t for i, t, _ in sets if i not in (3, 11)}
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in one.items()}
    pieces = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert 0 < r["length"] <= 1024 and len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert pieces.keys() == ids.keys() and max(len(p) for p in pieces.values()) > 1
    for i, told in pieces.items():
        told.sort()
        assert [p for p, _, _ in told] == list(range(len(told))) and [s for _, s, _ in told] == [sum(n for _, _, n in told[:k]) for k in range(len(told))] and sum(n for _, _, n in told) == len(ids[i])
        assert all(n == 1024 for _, _, n in told[1:])
    for s in {r["sequence_id"] for r in got}:
        placed = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 1024


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_else_imports_the_subpackage():
    for p in [*HOME.glob("hearthlog/**/*.py"), *HOME.glob("tests/*.py"), HOME / "bench.py"]:
        if "llm" not in p.relative_to(HOME).parts:
            names = {n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.Import) for a in n.names}
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(HOME / "hearthlog", tmp_path / "hearthlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HOME / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
