"""Main text of web pages: the best-scoring contiguous run of words and tags."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A hash share of the table of three times so many pages is looked at; those of them that mark their article teach the weights.
SAMPLE = 1_000

# The roles of HTML elements, and words of class and id names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article aside body details dialog div fieldset figure footer form header head html main menu nav section table".split())
CONTENT = frozenset(("article", "main"))
# Sections that say nothing by themselves: they belong to the section around them.
NEUTRAL = frozenset("details div figure section table".split())
PROSE = frozenset("p h1 h2 h3 blockquote pre".split())
LEFT_OUT = frozenset("aside footer form header nav menu dialog fieldset".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|promo|promoted|sponsor(?:ed)?|comments?|replies|disqus|cookies?|consent|notices?|popup|modal|newsletter|subscribe|"
    r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|header|footer|share|sharing|social|related|recommended|toolbar|pagination|widget)(?:$|[\s_-])",
    re.I,
)
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}

_PART = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:[\"'][^>]*)?>?|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _section(name: str, attributes: str) -> tuple[str, bool]:
    """Signature of a sectioning element, and whether its kind or names say it is not the article."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    hinted = bool(HINTS.search(names))
    return (f"{name}!" if hinted else name), hinted or name in LEFT_OUT


def page_runs(page: str):
    """The page as runs (signature, words, text, block, inside): tags have no words.

    A run is a tag, or a stretch of text. ``signature`` of a text is its block element, its
    nearest section, and whether it is a link; that of a tag is its name and the section it
    stands in, and a section's start tag is the section alone. ``block`` counts the blocks it
    lies in and ``inside`` says whether explicit markup calls it the article's, None if the page
    has none. Open elements are counted by section, so a stray end tag costs no look at the stack;
    a quote without an end goes no further than its tag's ``>``.
    """
    runs: list[tuple[str, int, str, int, bool | None]] = []
    # Element, signature of the nearest section, left out, nearest block element.
    stack: list[tuple[str, str, bool, str]] = []
    opened: Counter = Counter()  # open elements, and those above each open section
    scopes: list[Counter] = [Counter()]
    endless: set[str] = set()  # raw elements that end nowhere behind
    block, at, marked = 0, 0, False
    content, out, links = 0, 0, 0

    def pop() -> None:
        nonlocal content, out, links
        name, _, left_out, _ = stack.pop()
        opened[name] -= 1
        if name in SECTIONS:
            scopes.pop()
        else:
            scopes[-1][name] -= 1
        content -= name in CONTENT
        out -= left_out
        links -= name == "a"

    while at < len(page):
        match = _PART.match(page, at)
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            part = match[0]
            if part.startswith(("<!", "<?")):
                continue
            words = len(part.split())
            section, holder = (stack[-1][1], stack[-1][3]) if stack else ("body", "body")
            runs.append((f"{holder}|{section}|{'a' if links else ''}", words, part, block, bool(content and not out)))
            continue
        if match[1]:
            if (opened if name in SECTIONS else scopes[-1])[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            block += name in BLOCKS
            runs.append((f"</{name}|{stack[-1][1] if stack else 'body'}>", 0, "", block, bool(content and not out)))
            continue
        if name in RAW:
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is None:
                endless.add(name)
            runs.append((f"<{name}|{stack[-1][1] if stack else 'body'}>", 0, "", block, bool(content and not out)))
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()) or (stack and stack[-1][0] not in BLOCKS and name in BLOCKS and opened["p"]):
            pop()
        around = stack[-1][1] if stack else "body"
        section, left_out = _section(name, match[3] or "") if name in SECTIONS else (around, False)
        if section in NEUTRAL and around not in ("body", "html"):
            section = around
        own = name in SECTIONS and section.rstrip("!") == name
        block += name in BLOCKS
        if name not in VOID:
            stack.append((name, section, left_out, name if name in BLOCKS else stack[-1][3] if stack else "body"))
            opened[name] += 1
            if name in SECTIONS:
                scopes.append(Counter())
            else:
                scopes[-1][name] += 1
            content += name in CONTENT
            marked |= name in CONTENT
            out += left_out
            links += name == "a"
        runs.append((f"<{section}>" if own else f"<{name}|{section}>", 0, " " if name == "br" else "", block, bool(content and not out)))
    return [(s, w, t, b, i if marked else None) for s, w, t, b, i in runs]


class RunWeights(dict):
    """Weight of a run's signature: of one word in it, or of a tag; unseen ones fall back on their parts.

    An unseen link weighs like the words around it in its block; only links in other than prose
    that nothing was learned of, outside marked articles, may be a list of links.
    """

    def __init__(self, learned: dict[str, float] | None = None):
        super().__init__(learned or {})
        self.learned = frozenset(self)

    def __missing__(self, signature: str) -> float:
        if signature.startswith("<"):
            name, _, section = signature.strip("</>").partition("|")
            value = -2.0 if name.endswith("!") or name in LEFT_OUT | {"script", "style"} else -0.1 if section in CONTENT else -0.3
        else:
            block, section, link = signature.split("|")
            words = f"{block}|{section}|"
            if section.endswith("!") or section in LEFT_OUT | {"head", "html"}:
                value = -1.0
            elif link:
                value = self[words] if section in CONTENT or block in PROSE or words in self.learned else -0.5
            else:
                value = 1.0 if block in PROSE else 0.5
                # A block not seen in articles before is as good as the article's others.
                if section in CONTENT:
                    value = max(value, self.get(f"|{section}|", value))
        self[signature] = value
        return value


def learned_weights(inside: Counter, outside: Counter) -> RunWeights:
    """Log odds of words by signature, and of all words of a section; tags cost what their odds say, and always something."""
    inside, outside = Counter(inside), Counter(outside)
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    for counts in (inside, outside):
        for signature, n in list(counts.items()):
            if not signature.startswith("<"):
                counts[f"|{signature.split('|')[1]}|"] += n
    weights = {}
    for signature in set(inside) | set(outside):
        a, b = inside[signature], outside[signature]
        if a + b < 20:
            continue
        if signature.startswith("<"):
            weights[signature] = float(np.clip(np.log((a + 0.5) / (b + 0.5)), -8, -0.1))
        else:
            weights[signature] = float(np.clip(np.log((a + 0.5) / total_in) - np.log((b + 0.5) / total_out), -4, 4))
    return RunWeights(weights)


def best_run(gains: list[float]) -> tuple[int, int]:
    """Range of the contiguous run with the largest sum, the first to reach it; (0, 0) if no gain is positive.

    One scan keeps the best sum that ends here and the best so far.
    """
    best, best_range, here, start = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(gains):
        if here <= 0 and gain > 0:
            here, start = 0.0, i
        here += gain
        if here > best:
            best, best_range = here, (start, i + 1)
    return best_range


def extract(page: str, weights: RunWeights) -> str:
    """Text of the best run of words and tags, block by block.

    All words of a stretch weigh the same, so it is added at once (``best_run``). The run is widened to whole blocks. Of the blocks in it those without a stretch of positive
    weight (adverts, forms, comments) stay out, the others are kept with all inline stretches.
    """
    runs = page_runs(page)
    gains = [weights[s] * (w or (1 if s.startswith("<") else 0)) for s, w, _, _, _ in runs]
    first, last = best_run(gains)
    while 0 < first < last and runs[first - 1][3] == runs[first][3]:
        first -= 1
    while 0 < last < len(runs) and runs[last][3] == runs[last - 1][3]:
        last += 1
    good = {block for (_, words, _, block, _), gain in zip(runs[first:last], gains[first:last]) if words and gain > 0}
    blocks: dict[int, list[str]] = {}
    for _, _, text, block, _ in runs[first:last]:
        if text and block in good:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, limit: int = SAMPLE) -> RunWeights:
    """Weights from pages whose markup names the article, among about three times ``limit`` pages.

    The hash of id and url decides which pages are looked at, so their number is near the bound
    and not exact. Only those pages are read whole; the driver gets counts of signatures.
    """
    share = min(1.0, 3 * limit / max(pages.count(), 1))
    some = pages.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_000)) < int(share * 1_000_000)).filter(F.col("html").rlike("(?i)<(article|main)[ >]"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                for page in batch.column("html").slice(at, 50).to_pylist():
                    for signature, words, _, _, within in page_runs(page):
                        (inside if within else outside)[signature] += words or (1 if signature.startswith("<") else 0)
        names = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[s] for s in names], pa.int64()), pa.array([outside[s] for s in names], pa.int64())], names=["signature", "inside", "outside"])

    counts = some.select("html").mapInArrow(count, "signature string, inside long, outside long")
    counts = counts.groupBy("signature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).filter("inside + outside >= 20").collect()
    return learned_weights(Counter({r["signature"]: r["inside"] for r in counts}), Counter({r["signature"]: r["outside"] for r in counts}))


def main_text(pages: DataFrame, limit: int = SAMPLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Words score by the element they stand in and tags cost, with weights learned from pages that
    mark their article; a linear scan finds the maximum-scoring run. Character references are
    decoded, white space inside a block is one space, blocks are joined by a line break.

    Null and empty pages have the empty text, repeated rows give equal rows, without labelled pages
    the weights of the element roles hold, an empty table gives no rows; other columns are not
    read.

    Returns page_id, url, text, n_chars.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    weights = pages.sparkSession.sparkContext.broadcast(dict(fit_weights(pages, limit)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = RunWeights(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [extract(page, known) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(run, schema)
