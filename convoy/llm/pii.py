"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, texts

KINDS = ("email", "ip", "card", "phone")
#: Documents with base spans that may train the field, tokens of a candidate, least probability of an added span.
SAMPLE, LONGEST, CERTAIN = 200, 24, 0.6
#: Characters beside a trigger that its window shows.
MARGIN = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start at the first digit of a run; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    found, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            upto = match.end()
            found.append((0, start, upto))
        at = text.find("@", max(at + 1, upto))
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((1, *match.span()))
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
            found.append((3, *match.span()))
    return sorted(found)


# -- windows and candidate segments

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_NUMBERS = re.compile(r"(?<![A-Za-z0-9_])[+(\[]?[0-9](?:[\x20\t]?[().\[\]/:+-]?[\x20\t]?[.)\]-]?[\x20\t]?(?:dot[\x20\t])?[0-9]){5,}(?![A-Za-z0-9_])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]+\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s)\s?[A-Za-z0-9-]+)+", re.I)
_SPELLED_HINT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sat\s[^\s]+\sdot\s", re.I)
_BRACKETS = frozenset("()[]{}<>")


def windows(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches around triggers that touch no taken span, overlapping ones merged."""
    hits = [m.span() for m in _NUMBERS.finditer(text)]
    if _SPELLED_HINT.search(text):
        hits += [m.span() for m in _SPELLED.finditer(text)]
    merged: list[list[int]] = []
    for start, end in sorted(hits):
        if any(a < end and start < b for a, b in taken):
            continue
        low, high = max(0, start - MARGIN), min(len(text), end + MARGIN)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    return [(a, b) for a, b in merged]


NAMES = (
    ["bias", "at", "at_word", "dots_after", "top_level", "word_inside", "local_ok", "plus", "opening", "dot_only", "four_octets", "octets_far", "luhn", "no_luhn"]
    + [f"digits_{d}" for d in ("0", "1-6", "7-8", "9", "10", "11", "12", "13-16", "17-19", "20+")]
    + [f"groups_{g}" for g in ("0", "1", "2", "3", "4", "5+")]
    + ["one_separator", "mixed_separators", "date", "time", "slash", "glued_left", "glued_right", "number_left", "number_right", "edge_sign", "unbalanced", "wide_gap", "goes_on", "goes_back", "phone_groups", "bracketed_area"]
)
_INDEX = {name: i for i, name in enumerate(NAMES)}


def _at_tokens(tokens: list[str]) -> list[bool]:
    """Tokens that say "at": the sign, the word in brackets, or the word when a "dot" follows."""
    low = [t.lower() for t in tokens]
    return [t == "@" or (t == "at" and ((i and low[i - 1] in "([{<") or "dot" in low[i + 1 : i + 5])) for i, t in enumerate(low)]


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Token spans of a window, and its candidate segments (first token, token after, features)."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in spans]
    low, at, n = [t.lower() for t in tokens], _at_tokens(tokens), len(spans)
    found = []
    for i in range(n):
        if not (tokens[i].isalnum() or tokens[i] in "+(["):
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if j - i > 1 and spans[j - 1][0] - spans[j - 2][1] > 2:
                break
            last = tokens[j - 1]
            if not (last.isalnum() or last in ")]"):
                continue
            inside = range(i, j)
            says_at = sum(at[k] for k in inside)
            words = sum(tokens[k].isalpha() and low[k] not in ("at", "dot") for k in inside)
            digits = "".join(tokens[k] for k in inside if tokens[k].isdigit())
            if says_at > 1 or (not says_at and (words or len(digits) < 4)):
                if words and not any(at[i : i + LONGEST]):
                    break
                continue
            found.append((i, j, _features(text, spans, tokens, low, at, i, j, digits, says_at, words)))
    return spans, found


def _features(text, spans, tokens, low, at, i, j, digits, says_at, words) -> list[int]:
    names = ["bias"]
    groups = [tokens[k] for k in range(i, j) if tokens[k].isdigit()]
    n = len(digits)
    names.append("digits_" + ("0" if not n else "1-6" if n < 7 else "7-8" if n < 9 else str(n) if n < 13 else "13-16" if n < 17 else "17-19" if n < 20 else "20+"))
    names.append("groups_" + (str(len(groups)) if len(groups) < 5 else "5+"))
    between = [text[spans[k][1] : spans[k + 1][0]] for k in range(i, j - 1)]
    if any(len(b) > 1 for b in between):
        names.append("wide_gap")
    if says_at:
        k = next(k for k in range(i, j) if at[k])
        names += ["at", "at_word"] if low[k] == "at" else ["at"]
        after = [low[x] for x in range(k + 1, j) if tokens[x] not in _BRACKETS]
        dots = [x for x, t in enumerate(after) if t in (".", "dot")]
        if dots and dots[-1] < len(after) - 1 and dots[0] > 0:
            names.append("dots_after")
        if after and after[-1].isalpha() and 2 <= len(after[-1]) <= 10 and after[-1] not in ("at", "dot"):
            names.append("top_level")
        before = [x for x in range(i, k) if tokens[x] not in _BRACKETS]
        if before and all(spans[x][1] == spans[x + 1][0] for x in before[:-1]):
            names.append("local_ok")
        if any(text[spans[x][1] : spans[x + 1][0]] and tokens[x].isalnum() and tokens[x + 1].isalnum() and not {low[x], low[x + 1]} & {"at", "dot"} for x in range(i, j - 1)):
            names.append("word_inside")
    else:
        signs = {tokens[k] for k in range(i, j) if not tokens[k].isalnum()} | {low[k] for k in range(i, j) if low[k] == "dot"}
        if signs and signs <= {".", "dot", "[", "]", "(", ")"} and signs & {".", "dot"}:
            names.append("dot_only")
            if len(groups) == 4:
                names.append("four_octets" if all(int(g[:4]) <= 255 for g in groups) else "octets_far")
        if 13 <= n <= 19:
            names.append("luhn" if luhn(digits) else "no_luhn")
        if [len(g) for g in groups][-3:] == [3, 3, 4] and len(groups) in (3, 4):
            names.append("phone_groups")
        if "(" in signs and len(groups) > 1:
            names.append("bracketed_area")
        kinds = signs - {"+", "(", ")", "[", "]"}
        names += ["one_separator"] if len(kinds) == 1 else ["mixed_separators"] if len(kinds) > 1 else []
        sizes = [len(g) for g in groups]
        if sizes[:3] in ([4, 2, 2], [2, 2, 4], [4, 1, 2], [4, 2, 1], [4, 1, 1], [1, 1, 4], [2, 1, 4], [1, 2, 4]):
            names.append("date")
        if ":" in signs:
            names.append("time")
        if "/" in signs:
            names.append("slash")
    if tokens[i] == "+":
        names.append("plus")
    if tokens[i] in "([":
        names.append("opening")
    if not (tokens[i].isalnum() or tokens[i] in "+(") or not tokens[j - 1].isalnum():
        names.append("edge_sign")
    inner = [tokens[k] for k in range(i, j)]
    if any(inner.count(a) != inner.count(b) for a, b in ("()", "[]", "{}", "<>")):
        names.append("unbalanced")
    if i and spans[i - 1][1] == spans[i][0] and tokens[i - 1] not in "\"':;,=>":
        names.append("glued_left")
    if j < len(tokens) and spans[j - 1][1] == spans[j][0] and tokens[j] not in ".,;:!?\"')<":
        names.append("glued_right")
    if j + 1 < len(tokens) and low[j] in (".", "-", "dot", "[", "(") and low[j + 1].isalnum() and spans[j + 1][1] - spans[j - 1][1] < 12 and (spans[j][1] == spans[j + 1][0] or low[j] == "dot" or spans[j][0] > spans[j - 1][1]):
        names.append("goes_on")
    if i > 1 and tokens[i - 1] in ".-_+%" and spans[i - 1][1] == spans[i][0] and spans[i - 2][1] == spans[i - 1][0]:
        names.append("goes_back")
    if i and tokens[i - 1].isdigit() and spans[i][0] - spans[i - 1][1] < 2:
        names.append("number_left")
    if j < len(tokens) and tokens[j].isdigit() and spans[j][0] - spans[j - 1][1] < 2:
        names.append("number_right")
    return [_INDEX[name] for name in names]


# -- the field


@dataclass
class SegmentField:
    """Weights [kind, feature]; tokens outside entities score nothing."""

    weights: np.ndarray

    def scores(self, found: list) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) for _, _, f in found]).reshape(-1, len(KINDS))

    def marginals(self, n: int, found: list, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of every (candidate, kind) and the log of the sum over all segmentations."""
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, j, _) in enumerate(found):
            ending[j].append(c)
            starting[i].append(c)
        whole = np.logaddexp.reduce(scores, axis=1) if len(found) else np.zeros(0)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, n + 1):
            forward[t] = np.logaddexp.reduce([forward[t - 1], *(forward[found[c][0]] + whole[c] for c in ending[t])])
        for t in range(n - 1, -1, -1):
            backward[t] = np.logaddexp.reduce([backward[t + 1], *(backward[found[c][1]] + whole[c] for c in starting[t])])
        outer = np.array([forward[i] + backward[j] for i, j, _ in found]) - forward[n]
        return np.exp(np.minimum(scores + outer[:, None], 0)) if len(found) else scores, float(forward[n])

    def decode(self, text: str) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, probability): the best segmentation of a window, bounds and kinds at once."""
        spans, found = candidates(text)
        if not found:
            return []
        scores, n = self.scores(found), len(spans)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (_, j, _) in enumerate(found):
            ending[j].append(c)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            for c in ending[t]:
                kind = int(scores[c].argmax())
                if best[found[c][0]] + scores[c, kind] > best[t]:
                    best[t], back[t] = best[found[c][0]] + scores[c, kind], (c, kind)
        probability, _ = self.marginals(n, found, scores)
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                c, kind = back[t]
                i, j, _ = found[c]
                out.append((kind, spans[i][0], spans[j - 1][1], float(probability[c, kind])))
                t = i
        return out[::-1]


def train_field(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 15) -> SegmentField:
    """Conditional likelihood by Adagrad, with a pull to zero. Gold spans must be candidates."""
    data = []
    for text, gold in examples:
        spans, found = candidates(text)
        where = {(spans[i][0], spans[j - 1][1]): c for c, (i, j, _) in enumerate(found)}
        chosen = [(where[s, e], kind) for kind, s, e in gold if (s, e) in where]
        if found and len(chosen) == len(gold):
            data.append((len(spans), found, chosen))
    field = SegmentField(np.zeros((len(KINDS), len(NAMES))))
    field.weights[:, 0] = -1.0
    squares, rng = np.full_like(field.weights, 1e-2), random.Random(3)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, found, chosen in data:
            probability, _ = field.marginals(n, found, field.scores(found))
            gradient = -0.002 * field.weights
            for c, kind in chosen:
                gradient[kind, found[c][2]] += 1
            for c in np.flatnonzero(probability.max(axis=1) > 1e-3):
                gradient[:, found[c][2]] -= probability[c][:, None]
            squares += gradient**2
            field.weights += 0.3 * gradient / np.sqrt(squares)
    return field


def _rewritten(rng: random.Random, kind: int, value: str) -> str:
    """A base value as people write it when the base patterns miss it."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == 0:
        local, _, domain = value.partition("@")
        at = rng.choice(["(at)", "[at]", " (at) ", " [at] ", " at ", " @ ", "{at}", " AT "])
        dot = rng.choice([" dot ", "[dot]", "(dot)", " [dot] "]) if at.strip().lower() == "at" else rng.choice([".", ".", " dot ", "[dot]", "(dot)", " . "])
        return local + at + dot.join(domain.split("."))
    if kind == 1:
        return rng.choice([" . ", "[.]", "(.)", " dot "]).join(value.split("."))
    if kind == 2:
        return rng.choice([".", " - ", "/", ". "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    national = digits[-10:].rjust(10, "7")
    a, b, c = national[:3], national[3:6], national[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"+ 1 {a} {b} {c}", f"+1/{a}/{b}/{c}"])


def _harmless(rng: random.Random) -> str:
    """Numbers and addresses that are no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = number(rng.randint(13, 19))
    while luhn(card):
        card = number(rng.randint(13, 19))
    return rng.choice(
        [
            card, number(rng.randint(6, 12)), number(rng.randint(20, 30)), f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{rng.randint(1900, 2030)}",
            f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)} {number(2)}:{number(2)}:{number(2)}", f"{number(3)},{number(3)},{number(3)}", f"{number(1)}.{number(2)}.{number(3)}", f"{number(4)}.{number(8)}",
            f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)} {number(2)}", f"{number(4)}/{number(4)}", f"{number(2)}:{number(2)}:{number(2)}.{number(6)}",
        ]
    )


def examples_from(batch: list[str], seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around base spans as they are, rewritten ones, and the same windows with harmless numbers."""
    rng, out = random.Random(seed), []
    for text in batch:
        spans = base_spans(text)
        for kind, start, end in spans:
            low, high = max(0, start - MARGIN), min(len(text), end + MARGIN)
            if any((s, e) != (start, end) and s < high and low < e for _, s, e in spans):
                continue
            left, right = text[low:start], text[end:high]
            for value, gold in ((text[start:end], True), (_rewritten(rng, kind, text[start:end]), True), (_rewritten(rng, kind, text[start:end]), True), (_harmless(rng), False), (_harmless(rng), False)):
                out.append((left + value + right, [(kind, len(left), len(left) + len(value))] if gold else []))
    return out


def fit_field(docs: DataFrame, limit: int = SAMPLE) -> SegmentField:
    """The field learned from windows of at most ``limit`` base spans of ``docs`` (doc_id, text).

    The windows come from about a hundred times as many documents, chosen by a hash of the id.
    """
    share = min(1.0, 100 * limit / max(docs.count(), 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for _, batch in chunks(batches):
            found = [text[max(0, start - 2 * MARGIN) : end + 2 * MARGIN] for text in batch for _, start, end in base_spans(text)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in found], pa.int64()), pa.array(found, pa.string())], names=["h", "window"])

    rows = some.mapInArrow(cut, "h long, window string").filter("length(window) < 400").orderBy("h", "window").limit(limit).collect()
    return train_field(examples_from([r["window"] for r in rows]))


def all_spans(text: str, field: SegmentField) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each in the order of kinds and starts."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for low, high in windows(text, taken):
        for kind, start, end, probability in field.decode(text[low:high]):
            start, end = start + low, end + low
            if probability >= CERTAIN and not any(a < end and start < b for a, b in taken):
                added.append((kind, start, end))
    return base, sorted(base + added)


def personal_data(docs: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in every whole text.

    The base patterns decide what is found at least. Around numbers and spelled-out addresses that
    they miss, a semi-Markov conditional random field scores whole candidate segments and the
    best segmentation adds those it is sure of; no added span touches a base span. The field is
    trained on base spans of a bounded sample, on rewritten forms of them and on harmless numbers.

    Null and empty texts hold nothing, repeated rows give equal rows, an empty table gives no rows,
    other columns are not read.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans as
    kind:start:end), n_added.
    """
    docs = texts(docs, id_col, text_col)
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs, limit))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def listed(spans) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)

    def find(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for ids, batch in chunks(batches):
            out: list[list] = [[] for _ in names[1:]]
            for text in batch:
                base, every = all_spans(text, field.value)
                counts = [sum(kind == k for kind, _, _ in base) for k in range(len(KINDS))]
                for column, value in zip(out, (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base))):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), *(pa.array(c, t) for c, t in zip(out, kinds))], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    types = [T.LongType()] * 4 + [T.StringType(), T.StringType(), T.LongType()]
    return docs.mapInArrow(find, T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in zip(names[1:], types))]))
