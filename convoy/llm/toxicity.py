"""Toxicity: obfuscated words are restored through a noisy channel, then the restored text is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, fold, texts
from convoy.llm.quality import labelled_sample
from convoy.settings import staged

#: Labelled rows that may teach the word list.
LABELLED = 20_000
#: Lengths of the beginnings of a word that are counted beside the whole word.
BEGINNINGS = range(3, 8)
#: Normal quantile of the lower bound on a word's toxic share, and how far that is above the share of all rows.
QUANTILE, LEAST_LIFT = 2.0, 2.0
#: Words a worker remembers, and characters of pieces too long to be usual.
WORDS_KEPT, LONG_KEPT = 200_000, 1_000_000

# Letters the language model tells apart, and what signs may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}

# Costs of the channel in nats: reading a sign, skipping a sign, a digit, a separator, a doubled or a dragged letter, a blank.
READ, SKIP_SIGN, SKIP_DIGIT, SKIP_SEPARATOR, SKIP_DOUBLE, SKIP_DRAGGED, SKIP_BLANK = 2.5, 10.0, 14.0, 1.0, 5.0, 0.3, 1.0
# Words of readings of a run of short pieces that cost so much more than the best one count, too; the most a piece costs as a word of its own; pieces that may make one word.
MARGIN, LONE, LONGEST = 6.0, 6.0, 40

_BORDER, _OTHER = len(LETTERS), len(LETTERS) + 1
SIZE = len(LETTERS) + 2
_AFTER = ".,;:?!\"')]}…»"
_ENDING = re.compile(r"([.,;:?!\"')\]}…»]+|([*&%#$=~^_-])\2{2,})+$")
_START = re.compile(r"^[\"'(\[{«¿]+")
_DOUBLED = re.compile(r"(.)\1")
_DRAGGED = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_SHORT = re.compile(r"[\"'(\[{«¿]*+\S{1,2}(?:[.,;:?!\"')\]}…»*&%#$=~^_-]*+)")
# Shapes of pieces: another, short, short and a single character, only a single character.
_SHORT_RUN, _SINGLES = re.compile(rb"[\x01\x02]{3,}"), re.compile(rb"[\x02\x03]{3}")


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter number of every character below 0x250; other characters are borders or other letters."""
    table = np.full(0x250, _BORDER, np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = _OTHER
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
    return table


def letter_trigrams(batch: list[str]) -> np.ndarray:
    """Counts of all letter trigrams of the words of some texts, words padded by a border."""
    points = np.frombuffer("  ".join(batch).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 0x250, _codes()[np.minimum(points, 0x24F)], _OTHER)
    codes = np.concatenate(([_BORDER, _BORDER], codes, [_BORDER]))
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    # At a word's first letter the one before the border does not count; blanks after blanks are no event.
    first = np.where(second == _BORDER, _BORDER, first)
    event = (second != _BORDER) | (third != _BORDER)
    return np.bincount(((first * SIZE + second) * SIZE + third)[event], minlength=SIZE**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities [a, b, c] of a letter after two others, from every text.

    The table has a fixed size; tasks count their own texts and the counts are added by key.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SIZE**3, np.int64)
        for _, batch in chunks(batches):
            total += letter_trigrams(batch)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

    counts = np.zeros(SIZE**3)
    for row in docs.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row["code"]] = row["n"]
    three = counts.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
    p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
    p3 = (three + 8 * p2) / (three.sum(axis=2, keepdims=True) + 8)
    return -np.log(p3)


def _readings(piece: str) -> list[list[tuple[str, float]]]:
    """The lattice: for every character what it may stand for, with the channel's cost."""
    out, n = [], len(piece)
    for i, c in enumerate(piece):
        if c.isalpha():
            options = [(c, 0.0)]
            if i and piece[i - 1] == c:
                dragged = (i > 1 and piece[i - 2] == c) or (i + 1 < n and piece[i + 1] == c)
                options.append(("", SKIP_DRAGGED if dragged else SKIP_DOUBLE))
        else:
            options = [(letter, READ) for letter in LEET.get(c, "")]
            reads = bool(options) and c != "*"
            again = i > 0 and piece[i - 1] == c
            skip = SKIP_SEPARATOR if not (reads or c.isdigit()) else SKIP_DOUBLE if again else SKIP_DIGIT if c.isdigit() else SKIP_SIGN
            options.append(("", skip))
        out.append(options)
    return out


_NUMBER = {c: i for i, c in enumerate(LETTERS)}
_BEFORE = {(_BORDER, _BORDER): (0.0, "")}


def _step(states: dict, options: list[tuple[str, float]], model: np.ndarray) -> dict:
    """The cheapest word so far by its last two letters, after one more character."""
    after: dict = {}
    if len(options) == 1 and len(states) == 1 and options[0][0]:
        # A letter that only stands for itself, after the only word so far.
        (((a, b), (cost, word)),), ((letter, price),) = states.items(), options
        c = _NUMBER.get(letter, _OTHER)
        return {(b, c): (cost + price + model[a][b][c], word + letter)}
    for (a, b), (cost, word) in states.items():
        for letter, price in options:
            if letter:
                c = _NUMBER.get(letter, _OTHER)
                state, total, longer = (b, c), cost + price + model[a][b][c], word + letter
            else:
                state, total, longer = (a, b), cost + price, word
            if state not in after or (total, longer) < after[state]:
                after[state] = (total, longer)
    return after


def _ended(states: dict, model: np.ndarray) -> tuple[float, str]:
    if len(states) == 1:
        (((a, b), (cost, word)),) = states.items()
        return cost + model[a][b][_BORDER], word
    return min([(cost + model[a][b][_BORDER], word) for (a, b), (cost, word) in states.items()])


def restore(piece: str, model: np.ndarray) -> str:
    """The likeliest word behind a piece: Viterbi over the lattice, states are the last two letters."""
    states = _BEFORE
    for options in _readings(piece):
        states = _step(states, options, model)
    return _ended(states, model)[1]


def without_doubles(word: str, model: np.ndarray) -> str:
    """What ``restore`` gives for letters with doubles but none three in a row.

    Both paths of a double are in the same state after the next character, so each double is settled
    by its neighbours.
    """
    kept, start, n = [], 0, len(word)
    for double in _DOUBLED.finditer(word):
        i = double.start()
        a = _NUMBER.get(word[i - 1], _OTHER) if i else _BORDER
        c = _NUMBER.get(word[i], _OTHER)
        d = _NUMBER.get(word[i + 2], _OTHER) if i + 2 < n else _BORDER
        if SKIP_DOUBLE + model[a][c][d] < model[a][c][c] + model[c][c][d]:
            kept.append(word[start : i + 1])
            start = i + 2
    return "".join(kept) + word[start:]


def joined_words(pieces: list[str], model: np.ndarray) -> list[str]:
    """Words that a run of short pieces may spell when blanks are skipped.

    The lattice goes over the whole run. A blank is kept, and is the border of two words, or
    skipped at a cost. A word of several pieces counts if the best reading of the run that holds
    it costs at most MARGIN more than the best of all, so a one-letter word beside letters set
    apart does not hide the word they spell.
    """
    readings, at, parts = _readings("".join(pieces)), 0, []
    for piece in pieces:
        parts.append(readings[at : at + len(piece)])
        at += len(piece)
    n = len(parts)

    known: dict[tuple, list[tuple[float, str]]] = {}

    def words_from(i: int) -> list[tuple[float, str]]:
        # Readings look two characters back and one ahead; long runs mostly repeat themselves.
        window = (min(i, 2), *pieces[max(i - 2, 0) : i + LONGEST + 1])
        if window in known:
            return known[window]
        found, states = [], {}
        # Up to the first character with a choice there is one path only.
        a, b, total, spelt = _BORDER, _BORDER, 0.0, ""
        for j in range(i, min(n, i + LONGEST)):
            for options in parts[j]:
                letter, price = options[0]
                if states or len(options) > 1:
                    states = _step(states or {(a, b): (total, spelt)}, options, model)
                elif letter:
                    c = _NUMBER.get(letter, _OTHER)
                    total, spelt = total + price + model[a][b][c], spelt + letter
                    a, b = b, c
                else:
                    total += price
            cost, word = _ended(states, model) if states else (total + model[a][b][_BORDER], spelt)
            found.append((cost + SKIP_BLANK * (j - i), word))
        found[0] = (min(found[0][0], LONE), found[0][1])
        if len(known) >= 1_000:
            known.clear()
        known[window] = found
        return found

    upto, rest = [0.0] + [np.inf] * n, [np.inf] * n + [0.0]
    for i in range(n):
        for j, (cost, _) in enumerate(words_from(i), i + 1):
            if upto[i] + cost < upto[j]:
                upto[j] = upto[i] + cost
    for i in range(n - 1, -1, -1):
        rest[i] = min([cost + rest[j] for j, (cost, _) in enumerate(words_from(i), i + 1)])
    out, most = [], rest[0] + MARGIN
    for i in range(n):
        out += [word for j, (cost, word) in enumerate(words_from(i), i + 1) if j > i + 1 and word and upto[i] + cost + rest[j] <= most]
    return out


def _core(piece: str) -> str:
    word = piece.rstrip(_AFTER)
    return word.lower() if word.isalpha() else _START.sub("", _ENDING.sub("", piece.lower()))


def restored_word(core: str, model: np.ndarray) -> str:
    """The word of the core of a piece of text without blanks; only odd pieces go through the channel."""
    if core.isalpha():
        if not _DOUBLED.search(core):
            return core
        return restore(core, model) if _DRAGGED.search(core) else without_doubles(core, model)
    if not any(c.isalpha() for c in core) and not any(c in LEET for c in core):
        return ""
    return restore(core, model)


def double_readings(core: str) -> list[str]:
    """A word of letters as written, and without one letter of each double; longer ones have their best path only."""
    if len(core) >= LONGEST or not core.isalpha() or _DRAGGED.search(core):
        return []
    found = [core[: m.end() - 1] + core[m.end() :] for m in _DOUBLED.finditer(core)]
    return [core, *found] if found else []


def _shape(piece: str) -> int:
    short = _SHORT.fullmatch(piece) is not None
    return (2 if short else 3) if len(piece) == 1 else int(short)


class _Words(dict):
    """Restored word of a piece.

    ``doubles`` has further readings of words with doubles, ``shapes`` the short pieces and
    ``runs`` the words that runs of them may spell.
    """

    def __init__(self, model: np.ndarray):
        # Plain lists: single numbers of an array are slow to read.
        self.model = model.tolist()
        self.doubles: dict[str, list[str]] = {}
        self.shapes: dict[str, int] = {}
        self.runs: dict[str, list[str]] = {}
        self.long = 0

    def joined(self, run: list[str]) -> list[str]:
        pieces = [core for core in map(_core, run) if core]
        name = " ".join(pieces)
        if name not in self.runs:
            found = joined_words(pieces, self.model)
            if len(self.runs) >= WORDS_KEPT or len(name) >= 40:
                return found
            self.runs[name] = found
        return self.runs[name]

    def __missing__(self, piece: str) -> str:
        core = _core(piece)
        if core.isalpha() and not _DOUBLED.search(core):
            word = core
        else:
            word = restored_word(core, self.model)
            if also := double_readings(core):
                self.doubles[piece] = also
        if (len(core) < 3 or not core.isalpha()) and (shape := _shape(piece)):
            self.shapes[piece] = shape
        if len(piece) < 40:
            self[piece] = word
        elif piece in self.doubles or piece in self.shapes:
            self.long += len(piece)
        return word

    def make_room(self) -> None:
        if max(len(self), len(self.doubles), len(self.shapes)) >= WORDS_KEPT or self.long >= LONG_KEPT:
            self.clear()
            self.doubles.clear()
            self.shapes.clear()
            self.long = 0


def restored_words(text: str, words: _Words) -> set[str]:
    """Distinct restored words of a text; short pieces set apart by blanks are joined, too."""
    # Between texts, so that the readings of this text's pieces are all there.
    words.make_room()
    listed = text.split()
    pieces = set(listed)
    found = set(map(words.__getitem__, pieces))
    for piece in pieces & words.doubles.keys():
        found.update(words.doubles[piece])
    shapes = bytes(map(words.shapes.get, listed, repeat(0)))
    if _SINGLES.search(shapes):
        for spaced in _SPACED.findall(text):
            found.add(words["".join(spaced.split())])
    for run in _SHORT_RUN.finditer(shapes):
        found.update(words.joined(listed[run.start() : run.end()]))
    found.discard("")
    return found


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if k < len(word))]


@dataclass
class ToxicityModel:
    """Language model, evidence of words and beginnings, and the calibration of a text's evidence."""

    letters: np.ndarray
    evidence: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        # Evidence of every counted beginning, and nothing for the beginnings that lead to one.
        self.starts = {f[1 : k + 1]: 0.0 for f in self.evidence if f[0] == "^" for k in BEGINNINGS}
        self.starts |= {f[1:]: w for f, w in self.evidence.items() if f[0] == "^"}

    def weight(self, word: str) -> float:
        """The most evidence of a word or one of its beginnings."""
        best = self.evidence.get("=" + word, 0.0)
        for k in BEGINNINGS:
            here = self.starts.get(word[:k]) if k < len(word) else None
            if here is None:
                break
            if here > best:
                best = here
        return best

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def summary(weights: list[float], words: int) -> list[float]:
    """What the calibration sees of a text: evidence in all, its best word, and evidence for its length."""
    found = sorted(w for w in weights if w)
    total = sum(found)
    return [min(total, 30.0), found[-1] if found else 0.0, min(10 * total / max(words, 10), 10.0), min(total, 30.0) / np.sqrt(1 + words / 100), 1.0]


#: The calibration is pulled weakly towards these weights of the summary.
PRIOR = np.array([0.2, 0.5, 0.2, 0.2, -3.0])


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with a weak pull towards PRIOR, by Newton steps."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.5 * (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), gradient).clip(-1, 1)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> ToxicityModel:
    """Letters from all of ``docs`` (doc_id, text); words from at most ``limit`` labelled rows.

    Three quarters of the rows count, for each word and beginning, toxic and other documents;
    those whose toxic share is surely LEAST_LIFT times the usual one become evidence. The last
    quarter calibrates the evidence of a text.
    """
    spark = docs.sparkSession
    letters = language_model(docs)
    shared = spark.sparkContext.broadcast(letters)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _Words(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [sorted(restored_words(t, words)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.string())), part.column("y")], names=["doc_id", "words", "y"])

    # At most ``limit`` short rows.
    sample = F.broadcast(labelled_sample(labels, "toxic", 5, 0, limit).withColumnRenamed("doc_id", "label_id"))
    rows = docs.join(sample, docs["doc_id"] == sample["label_id"]).select("doc_id", "text", "y")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("y", T.DoubleType())])
    rows = staged(rows.mapInArrow(split, schema).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0), "toxic-words")

    beginnings = [F.when(F.length("word") > k, F.concat(F.lit("^"), F.substring("word", 1, k))) for k in BEGINNINGS]
    counted = (
        rows.filter("NOT calibrates")
        .select("doc_id", "y", F.explode("words").alias("word"))
        .select("doc_id", "y", F.explode(F.array(F.concat(F.lit("="), F.col("word")), *beginnings)).alias("feature"))
        .filter("feature IS NOT NULL")
        .distinct()
        .groupBy("feature")
        .agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    )
    z2, share = QUANTILE**2, F.col("toxic") / F.col("n")
    bound = (share + z2 / (2 * F.col("n")) - QUANTILE * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") ** 2))) / (1 + z2 / F.col("n"))
    usual = rows.filter("NOT calibrates").agg(F.avg("y")).first()[0] or 0.0
    usual = min(max(usual, 0.001), 0.9)
    surely = counted.withColumn("bound", bound).filter(F.col("bound") > min(LEAST_LIFT * usual, 0.95)).select("feature", "bound").collect()
    offset = np.log(usual / (1 - usual))
    model = ToxicityModel(letters, {r["feature"]: float(np.log(r["bound"] / (1 - r["bound"])) - offset) for r in surely}, PRIOR)

    shared_model = spark.sparkContext.broadcast(model)
    size = len(PRIOR)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [summary([shared_model.value.weight(w) for w in words], len(words)) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    held = rows.filter("calibrates").select("words", "y").mapInArrow(weigh, "x array<double>, y double").orderBy("x", "y").limit(limit).collect()
    if held:
        model.weights = _calibrated(np.array([r["x"] for r in held]).reshape(-1, size), np.array([r["y"] for r in held]))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for toxicity.

    Pieces with signs, digits or doubled letters inside, and runs of short pieces set apart by any
    blanks, form a lattice of readings; the best path under a letter language model of all
    documents is the restored word. Over runs the model also chooses the borders of words.
    A text's score is the calibrated evidence of its distinct restored words.

    Null and empty texts have no evidence, repeated rows the same score each, null ids are scored
    too, without labels no word is evidence, an empty table gives no rows; other columns are not
    read.

    Returns doc_id, held_out, score, predicted.
    """
    docs = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, limit))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _Words(model.value.letters)
        nothing: set[str] = set()
        for ids, batch in chunks(batches):
            found = []
            for text in batch:
                here = restored_words(text, words)
                if len(nothing) > WORDS_KEPT:
                    nothing.clear()
                weights = {word: model.value.weight(word) for word in here - nothing}
                nothing.update(word for word, weight in weights.items() if not weight)
                found.append(summary(list(weights.values()), len(here)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(model.value.scores(np.array(found)))], names=["doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    scored = docs.mapInArrow(score, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
