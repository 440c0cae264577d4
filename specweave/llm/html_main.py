"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and text runs. Words score positive and
tags negative; menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are no part of the sequence, and words beside
a marked content element score negative. One linear scan finds the contiguous
region with the highest sum; its text is the result.

Cue words of class, id and role attributes count only where the whole name is made
of cues and words of layout (``cookie-notice``, not ``notice-period``), and never on
a heading. A strong cue or a role drops its element; a weak one (``search``,
``related``), inside a marked article, only where at least half of the element's
words are links or it holds more controls than words, so a section named after its
subject stays.

Weights are log-odds learned from labelled pages, those whose markup marks the
content itself (exactly one ``article`` or ``main``): how much more often a word
in a context, or a tag, lies inside than outside of it. Each labelled page also
counts as if it had no such mark, which gives the weights of unmarked pages; a
tag not met there has its weight over all places. The model has one number per
context and tag of a fixed list, whatever the corpus.

Text: character references decoded, white space inside a block turned into one
space, blocks joined by a line end; nothing else is dropped and no length is
limited. Null or empty html gives an empty text. Rows are kept one for one.
Ties between regions go to the first and shorter.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need

# Element names of the HTML standard, by use here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")
DROPPED = frozenset(
    "head title script style noscript template svg iframe object canvas nav aside footer form button select "
    "option textarea menu dialog audio video xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# Words of class, id and role attributes that mark other content,
# first those that hardly name a section of an article, then those that may.
STRONG_CUES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies gdpr popup modal sidebar nav navbar "
    "breadcrumb breadcrumbs comment comments replies disqus newsletter subscribe toolbar widget pagination pager "
    "searchbox alertdialog".split()
)
WEAK_CUES = frozenset(
    "advertising promotion banner notice consent overlay navigation menu footer header masthead reply respond share "
    "sharing social related recommended subscription signup login search complementary contentinfo alert".split()
)
CUES = STRONG_CUES | WEAK_CUES
# Words that say nothing of the content when they stand beside a cue.
LAYOUT = frozenset(
    "area article articles aside bar block bottom box btn button card col column container content entry form global "
    "group holder icons inner item items left link links list main outer page panel post posts right row section site "
    "slot stories sticky thread top unit wrap wrapper".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTROLS = ("form", "input", "button", "select", "textarea")
MAIN = ("article", "main")

SMOOTHING = 1.0
WORD_LIMITS = (0.5, 4.0)
TAG_LIMITS = (0.01, 4.0)
UNSEEN_TAG = 0.1

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?|[^<]+|<",
    re.DOTALL,
)
_MARK = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_CUE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """Tokens of a page: (tag name or None, text or None, element)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str | None, str | None, int]] = []
        self.name, self.parent, self.own, self.cued = [""], [0], [False], [0]
        self._read(source)
        n = len(self.name)
        words, linked, controls, headed, holds = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
        for _, text, element in self.tokens:
            if text is not None:
                words[element] += len(text.split())
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            words[up] += words[e]
            linked[up] += words[e] if self.name[e] == "a" else linked[e]
            controls[up] += controls[e] + (self.name[e] in CONTROLS)
            headed[up] |= headed[e] or self.name[e] == "h1"
            holds[up] |= holds[e] or self.name[e] in MAIN
        self.marks = [e for e in range(1, n) if self.name[e] in MAIN]
        self.out, self.inside = [False] * n, [False] * n
        visible = words[0]
        for e in range(1, n):
            up, name = self.parent[e], self.name[e]
            main = self.inside[up] or name in MAIN
            dropped = self.own[e] or (name == "header" and not self.inside[up] and not holds[e])
            if self.cued[e] and not holds[e] and not (headed[e] and 2 * words[e] > visible):
                other = 2 * linked[e] >= words[e] or controls[e] > words[e]
                dropped = dropped or other or self.cued[e] > 1 or not self.inside[up]
            self.out[e] = self.out[up] or dropped
            self.inside[e] = main and not self.out[e] if name in MAIN else self.inside[up]
        self.marked = any(self.inside)

    def _read(self, source: str) -> None:
        stack, open_names, at, end = [0], Counter(), 0, len(source)
        match = _TOKEN.match
        while at < end:
            m = match(source, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0][0] != "<" or m[0] == "<":
                    self.tokens.append((None, _html.unescape(m[0]), stack[-1]))
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                self.tokens.append((name, None, stack[-1]))
                if open_names[name]:
                    while True:
                        e = stack.pop()
                        open_names[self.name[e]] -= 1
                        if self.name[e] == name:
                            break
                continue
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and self.name[stack[-1]] == name:
                open_names[name] -= 1
                stack.pop()
            e = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.own.append(name in DROPPED or bool(attributes and _HIDDEN.search(attributes)))
            self.cued.append(_cued(attributes) if attributes and name not in ("html", "body", *HEADINGS) else 0)
            self.tokens.append((name, None, e))
            if name in VOID or attributes.endswith("/"):
                continue
            if name in RAW:
                close = _RAW_END[name].search(source, at)
                at = close.end() if close else end
                continue
            stack.append(e)
            open_names[name] += 1

    def context(self, element: int, marked: bool) -> str:
        if self.out[element]:
            return "out"
        if not marked:
            return "plain"
        return "main" if self.inside[element] else "beside"


def _cued(attributes: str) -> int:
    """0: no cue, 1: a weak one, 2: a strong one or a role."""
    found = 0
    for m in _MARK.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [w.lower() for w in _CUE_WORD.findall(name)]
            if any(w in CUES for w in parts) and all(w in CUES or w in LAYOUT or w.isdigit() for w in parts):
                found = max(found, 2 if m[1].lower() == "role" or any(w in STRONG_CUES for w in parts) else 1)
    return found


KNOWN_TAGS = BLOCKS | DROPPED | VOID | frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd label legend mark q s samp small span strong sub sup time u var".split())


def _tag(name: str) -> str:
    return name if name in KNOWN_TAGS else "other"


def features(page: Page) -> Iterator[tuple[str, bool, int]]:
    """(feature, inside, count) of a labelled page, with its mark and without."""
    for name, text, element in page.tokens:
        inside = page.inside[element] and not page.out[element]
        n = 1 if text is None else len(text.split())
        if not n:
            continue
        if text is None:
            yield f"any {_tag(name)}", inside, n
        if page.out[element]:
            continue
        for marked in (True, False):
            yield f"{page.context(element, marked)} {'#word' if text is not None else _tag(name)}", inside, n


def labelled(page: Page) -> bool:
    return sum(not page.out[e] for e in page.marks) == 1


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weight by feature, from (inside, outside) counts; defaults where unseen."""
    total_in, total_out = (sum(c[i] for c in counts.values()) for i in (0, 1))
    found = {"plain #word": 1.0, "main #word": 1.0, "beside #word": -1.0}
    for feature, (n_in, n_out) in counts.items():
        odds = math.log((n_in + SMOOTHING) / (total_in + 2 * SMOOTHING)) - math.log((n_out + SMOOTHING) / (total_out + 2 * SMOOTHING))
        if feature.endswith("#word"):
            low, high = WORD_LIMITS
            sign = 1.0 if feature in ("plain #word", "main #word") else -1.0
            found[feature] = sign * min(high, max(low, sign * odds))
        else:
            low, high = TAG_LIMITS
            found[feature] = -min(high, max(low, -odds))
    return found


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the highest sum; empty if none is positive."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, start, end = total, first, i + 1
    return start, end


def main_text(source: str | None, weight: dict[str, float]) -> str:
    if not source:
        return ""
    page = Page(source)
    scores = []
    for name, text, element in page.tokens:
        context = page.context(element, page.marked)
        if context == "out":
            scores.append(0.0)
        elif text is not None:
            scores.append(len(text.split()) * weight[f"{context} #word"])
        else:
            at = f"{context} {_tag(name)}"
            if at not in weight and context == "plain":
                at = f"any {_tag(name)}"
            scores.append(weight.get(at, -UNSEEN_TAG))
    start, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for name, text, element in page.tokens[start:end]:
        if text is not None:
            if page.context(element, page.marked) in ("main", "plain"):
                blocks[-1].append(text)
        elif name in BLOCKS:
            blocks.append([])
        elif name == "br":
            blocks[-1].append(" ")
    joined = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(b for b in joined if b)


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights from all labelled rows of ``pages`` (html)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inside, outside = Counter(), Counter()
        for b in batches:
            for source in b.column("html").to_pylist():
                page = Page(source)
                if labelled(page):
                    for feature, within, n in features(page):
                        (inside if within else outside)[feature] += n
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([inside[f] for f in names], pa.int64()), pa.array([outside[f] for f in names], pa.int64())],
            names=["feature", "n_in", "n_out"],
        )

    rows = need(pages, ("html",)).where("html IS NOT NULL AND html <> ''")
    counts = rows.mapInArrow(count, "feature string, n_in long, n_out long").groupBy("feature").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    return weights({r["feature"]: (r["n_in"], r["n_out"]) for r in counts.collect()})  # contexts x known tags


def extract(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(page_id, url, text) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [main_text(s, weight) for s in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = need(pages, ("page_id", "url", "html")).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")
