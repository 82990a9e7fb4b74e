"""Quality rules: base counts of words, and divergence from language references by Jensen-Shannon distance."""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import lean

#: Share of each character class in ordinary prose, in the order of CLASSES.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide")
CHARACTERS = {
    "en": (0.785, 0.025, 0.005, 0.165, 0.019, 0.001, 0.000),
    "de": (0.775, 0.045, 0.005, 0.140, 0.019, 0.001, 0.015),
    "fr": (0.755, 0.020, 0.005, 0.165, 0.024, 0.001, 0.030),
    "es": (0.775, 0.020, 0.005, 0.160, 0.019, 0.001, 0.020),
}
#: Frequent words of each language, with their share of ordinary prose in thousandths.
WORDS = {
    "en": "the 60 of 30 and 28 to 26 in 21 a 21 is 11 that 11 for 10 it 9 was 9 on 7 with 7 as 7 be 6 by 6 at 5 are 5 this 5 from 4 or 4 have 4 an 3 not 5",
    "de": "der 35 die 34 und 28 in 19 den 13 von 11 zu 11 das 11 mit 9 sich 8 des 8 auf 8 für 8 ist 8 im 8 dem 7 nicht 7 ein 7 eine 6 als 6 auch 5 es 5 an 5 aus 4",
    "fr": "de 50 la 30 le 26 et 24 les 20 des 18 à 17 en 16 un 12 du 12 une 10 que 10 est 9 dans 9 qui 8 pour 8 par 7 sur 6 au 6 il 6 pas 5 plus 4 avec 4 ce 4",
    "es": "de 60 la 38 que 30 el 29 en 27 y 26 a 20 los 17 se 12 del 12 las 11 un 10 por 9 con 9 no 9 una 8 su 8 para 7 es 7 al 6 lo 6 como 5 más 4 o 4",
}
#: Characters that end or surround words in prose; the divergence of words reads them as spaces.
STOPS = ".,;:!?\"'()-"


@dataclass(frozen=True)
class Rules:
    """Limits of the method. Texts below a least length are left to the base rules alone.

    most_word_distance follows from the default references (`word_limit`), so that a text without frequent words is
    further from all of them than allowed.
    """

    characters: dict = field(default_factory=lambda: dict(CHARACTERS))
    words: dict = field(default_factory=lambda: Rules.word_shares())
    least_chars: int = 200
    least_words: int = 40
    most_char_distance: float = 0.25
    most_word_distance: float = field(default_factory=lambda: word_limit(Rules.word_shares()))

    @staticmethod
    def word_shares() -> dict:
        return {k: {w: int(n) / 1000 for w, n in zip(v.split()[::2], v.split()[1::2])} for k, v in WORDS.items()}


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least_share: float = 1 / 2000) -> Rules:
    """Rules whose references are those of a trusted corpus: for each language its shares of character classes and of words.

    Words with at least `least_share` of a language's words are kept, so at most 1 / least_share of them, and only these
    come to the driver. Texts without a language, and null ones, are left out. A language without frequent words, as one
    without spaces, says that texts may have none: they lie at its reference, and the limit comes from the others. An
    empty corpus gives no references, and then the base rules alone judge.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    patterns = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?\x22\x27()\-]", None, r"[\x00-\x7F]"]
    counts = {c: F.length(F.regexp_replace("text", p, "")) for c, p in zip(CLASSES, patterns) if p}
    counts["symbol"] = F.length("text") - sum(counts.values(), F.lit(0))
    sums = rows.groupBy("lang").agg(*[F.sum(counts[c]).alias(c) for c in CLASSES]).collect()  # a row for each language
    characters = {r["lang"]: tuple(r[c] / max(sum(r[k] for k in CLASSES), 1) for c in CLASSES) for r in sums}
    plain = F.translate(F.col("text"), string.ascii_uppercase + STOPS, string.ascii_lowercase + " " * len(STOPS))
    words = rows.select("lang", F.explode(F.regexp_extract_all(plain, F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("total")))  # a row for each language
    frequent = words.join(total, "lang").filter(F.col("n") >= least_share * F.col("total")).select("lang", "word", (F.col("n") / F.col("total")).alias("share")).collect()
    shares: dict[str, dict[str, float]] = {lang: {} for lang in characters}
    for r in frequent:
        shares[r["lang"]][r["word"]] = r["share"]
    return Rules(characters=characters, words=shares, most_word_distance=word_limit(shares))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that are found twice or more, each word counted once."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, span = ids, 1
    while span < width:  # numbers of longer and longer windows, without collisions
        step = min(span, width - span)
        key = key[: len(key) - step] * (int(key.max()) + 1) + key[step:] if step == span else key[: len(key) - step] * len(number) + ids[span:]
        span += step
        if span < width or key.max() > 2**40:
            key = np.unique(key, return_inverse=True)[1]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    start = np.isin(key, twice)
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:-width][start] += 1
    edge[width:][start] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


_KIND = np.full(256, CLASSES.index("wide"), np.int64)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = CLASSES.index("lower" if _c.islower() else "upper" if _c.isupper() else "digit" if _c.isdigit() else "space" if _c in " \t\n\x0b\x0c\r" else "stop" if _c in STOPS else "symbol")
_KIND_OF = np.zeros((256, len(CLASSES)), np.int64)
_KIND_OF[np.arange(256), _KIND] = 1
_KIND_OF[128:192] = 0  # bytes that continue a character
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACES = [9, 10, 11, 12, 13, 32]
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + STOPS.encode(), b"abcdefghijklmnopqrstuvwxyz" + b" " * len(STOPS))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p to the distribution q; 1 where p is empty."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 1.0)


def word_limit(words: dict, share: float = 0.01) -> float:
    """The least distance to its reference of a text that holds `share` of frequent words, in their proportions.

    References without words don't count; without any other nothing is too far.
    """
    out = [1.0]
    for ws in filter(None, words.values()):
        q = np.array([*ws.values(), 1 - sum(ws.values())])
        p = np.array([*(share * x / sum(ws.values()) for x in ws.values()), 1 - share])
        out.append(float(distance(1e6 * p[None], q)[0]))
    return round(min(out), 4)


def measure(texts: list[str | None], rules: Rules) -> list[tuple]:
    """For each text: the counts of the contract, and the two least distances to a reference, 0 where there is none."""
    vocabulary = sorted({w for ws in rules.words.values() for w in ws})
    position = {w.encode(): i for i, w in enumerate(vocabulary)}
    counts, kinds, common = [], np.zeros((len(texts), len(CLASSES))), np.zeros((len(texts), len(vocabulary) + 1))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        per = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words = data.split()
        lines, seen, again = data.split(b"\n"), set(), 0
        for line in lines:
            if line.strip():
                again += line in seen
                seen.add(line)
        chars = len(data) - int(per[128:192].sum())
        counts.append((len(words), chars - int(per[_SPACES].sum()), int(per[_SYMBOLS].sum()), again, repeated_words(words)))
        kinds[i] = per @ _KIND_OF
        plain = Counter(data.translate(_PLAIN).split())
        for w in plain.keys() & position.keys():
            common[i, position[w]] = plain[w]
        common[i, -1] = sum(plain.values()) - common[i].sum()
    least = lambda found: np.min(found, axis=0) if found else np.zeros(len(texts))
    by_char = least([distance(kinds, np.array(q)) for q in rules.characters.values()])
    reference = [np.array([*(ws.get(w, 0) for w in vocabulary), 1 - sum(ws.values())]) for ws in rules.words.values()]
    by_word = least([distance(common, q) for q in reference])
    return [(*c, round(float(a), 6), round(float(b), 6)) for c, a, b in zip(counts, by_char, by_word)]


def score(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: its counts, distances and verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and char_distance
    and word_distance, the least Jensen-Shannon distances to any language reference. A text that fails no base
    rule is kept unless it is long enough to be judged and lies further from every reference than allowed.
    Null and empty texts have no words and fail the base rules; repeated rows give repeated rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, texts = part.column(0), part.column(1).to_pylist()
                columns = list(zip(*measure(texts, rules)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.float64()) for c in columns[5:]), pa.array([len(t or "") for t in texts], pa.int64())], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "n_chars"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = {"char_distance": "double", "word_distance": "double"}
    out = rows.mapInArrow(run, ", ".join(f"{n} {kind.get(n, 'long')}" for n in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.col("n_chars") >= rules.least_chars) & (F.col("char_distance") > rules.most_char_distance) | (F.col("n_words") >= rules.least_words) & (F.col("word_distance") > rules.most_word_distance)
    return out.select(*names[:6], failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")


def keep_good(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, in all their columns, without a shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(place).to_pylist()
                yield part.filter(pa.array([verdict(len(t or ""), m, rules) for t, m in zip(texts, measure(texts, rules))]))

    place = docs.columns.index(text_col)
    return docs.mapInArrow(lean(run), docs.schema)


def verdict(n_chars: int, measured: tuple, rules: Rules) -> bool:
    n_words, _, _, _, n_repeat, by_char, by_word = measured
    far = n_chars >= rules.least_chars and by_char > rules.most_char_distance or n_words >= rules.least_words and by_word > rules.most_word_distance
    return not (n_words < 10 or 100 * n_repeat > 20 * n_words or far)
