"""Main text of web pages: boosted trees over DOM-node features, decoded along the hierarchy.

Each element of a page is described by its depth, the text, links and punctuation of its subtree, its place
among its siblings and theirs, and the tokens of its tag and of its class, id and role attributes, its own
and its ancestors'. Gradient-boosted trees (logistic loss, histogram splits, numpy) give the log odds that an
element's own text is article text. They are fitted on pages written by a seeded generator: articles among
menus, headers, footers, sidebars, notices, adverts, forms, comments, with and without telling tags and
names. Decoding takes the set of elements with the largest sum of log odds, weighted by own text, such that an
element is taken only with its parent; so no descendant of rejected parts is kept. Inline elements without telling
names, amid the own text of their parent, are taken or left with it.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined by one line end; scripts, styles, comments, templates and the head are never text, math and svg text is. Defined cases: null
or empty html and pages without article text give an empty text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Element names of HTML by their behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe title select datalist annotation annotation-xml".split())
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd merror maction".split())
INLINE |= set("svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol lineargradient radialgradient stop clippath mask pattern marker filter image switch view animate".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "article", "section", "td", "li", "body"}}
# Words that name parts of a page.
GOOD = "article main content post entry story text body".split()
BAD = "nav menu header footer sidebar aside ad ads advert banner promo sponsor cookie notice consent alert popup modal comment comments discussion reply form newsletter subscribe share social related breadcrumb pagination login search widget copyright legal tags byline toolbar".split()
TAGS = "html body div section article main nav header footer aside form ul ol li a p h1 h2 h3 h4 h5 h6 table tr td span b i em strong blockquote pre figure figcaption button label dl dt dd th thead tbody caption code kbd samp".split()
TOKENS = {t: i for i, t in enumerate(dict.fromkeys([*TAGS, *GOOD, *BAD]))}
WIDE = -(-len(TOKENS) // 8) * 8
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?]")


def raw_end(source: str, name: str, at: int) -> int:
    """Where a raw element's own end tag ends, or the page; nothing in it is a tag, but templates nest."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>" if name == "template" else rf"<(/){name}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.end()
    return len(source)


class Page:
    """Elements in document order (0 is the page itself) and its text: (element, text) with None between blocks."""

    __slots__ = ("tag", "parent", "depth", "own", "link", "mark", "token", "above", "end", "text")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.own, self.link, self.mark = ["#"], [-1], [0], [0], [0], [0]
        self.token, self.above, self.end = [0], [0], [0]
        self.text: list[tuple[int, str] | None] = []
        open_, at, head = [0], 0, False
        count: dict[str, int] = {}  # of open elements, by name
        text, tag = self.text, self.tag

        def shut_from(i: int) -> None:
            for k in open_[i:]:
                self.end[k] = len(tag)
                count[tag[k]] -= 1
            del open_[i:]

        def leave_head() -> None:
            nonlocal head
            head = False
            if count.get("head"):
                shut_from(next(i for i, k in enumerate(open_) if tag[k] == "head"))

        def say(raw: str) -> None:
            if head and not raw.isspace():
                leave_head()
            if not head and not raw.isspace():
                own = open_[-1]
                shown = html.unescape(raw)
                n = len(shown.strip())
                self.own[own] += n
                if any(tag[k] == "a" for k in open_[-4:]):
                    self.link[own] += n
                self.mark[own] += len(MARKS.findall(shown))
                text.append((own, shown))
            elif raw and not head:
                text.append((open_[-1], " "))

        while m := TOKEN.search(source, at):
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            if not name:
                continue
            name = name.lower()
            if head and name not in IN_HEAD and not close:  # its end tag may be left out
                leave_head()
            if name in ("head", "body"):
                head = name == "head" and not close
            if close:
                if count.get(name):
                    i = len(open_) - 1
                    while tag[open_[i]] != name:
                        i -= 1
                    shut_from(i)
                if name not in INLINE:
                    text.append(None)
                continue
            if name in RAW or name in ("desc", "metadata") and count.get("svg"):
                at = at if attrs.endswith("/") else raw_end(source, name, at)
                text.append(None) if name not in INLINE else None
                continue
            if name not in INLINE:
                text.append(None)
                shut = CLOSES.get(name) or ({"p"} if name not in ("p", "html", "body") else set())
                fence = FENCE.get(name, FENCE["p"])
                for i in range(len(open_) - 1, 0, -1) if any(map(count.get, shut)) else ():
                    if tag[open_[i]] in shut:
                        shut_from(i)
                        break
                    if tag[open_[i]] in fence:
                        break
            elif name in ("br", "mtd", "text"):
                text.append((open_[-1], " "))
            if name in VOID:
                continue
            me, up = len(tag), open_[-1]
            bits = 1 << TOKENS[name] if name in TOKENS else 0
            if attrs and "=" in attrs:
                for found in NAMED.findall(attrs):
                    for w in WORD.findall(("".join(found)).lower()):
                        if w in TOKENS:
                            bits |= 1 << TOKENS[w]
            tag.append(name)
            self.parent.append(up)
            self.depth.append(len(open_))
            self.own.append(0)
            self.link.append(0)
            self.mark.append(0)
            self.token.append(bits)
            self.above.append(self.above[up] | bits)
            self.end.append(0)
            if not attrs.endswith("/"):
                open_.append(me)
                count[name] = count.get(name, 0) + 1
            else:
                self.end[me] = me + 1
        if at < len(source):
            say(source[at:])
        for k in open_:
            self.end[k] = len(tag)


def describe(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all elements of some pages, and where each page starts."""
    sizes = [len(p.tag) for p in pages]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    base = np.repeat(starts[:-1], sizes)
    flat = lambda name: np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, starts[-1])
    parent, depth, own, link, mark, end = map(flat, ("parent", "depth", "own", "link", "mark", "end"))
    n = len(parent)
    place = np.arange(n)
    end, parent = end + base, np.where(parent < 0, place, parent + base)
    total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[:-1]
    chars, links, marks, nodes = total(own), total(link), total(mark), end - place
    page = chars[base]
    density = links / np.maximum(1, chars)
    # siblings: elements by parent, in order
    order = np.lexsort((place, parent))
    first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    index, count = np.empty(n), np.empty(n)
    index[order] = np.arange(n) - head
    group = np.cumsum(first) - 1
    count[order] = np.bincount(group)[group]
    log = np.log1p(chars)
    before, after = np.zeros(n), np.zeros(n)
    same = parent[order][1:] == parent[order][:-1]
    before[order[1:][same]] = log[order[:-1][same]]
    after[order[:-1][same]] = log[order[1:][same]]
    family = np.bincount(parent, chars, n)[parent]
    dense = np.stack(
        [depth, log, density, chars / nodes, marks / np.maximum(1, chars), np.log1p(own), chars / np.maximum(1, page), index / np.maximum(1, count), np.log1p(count), before, after, density[parent], log[parent], chars / np.maximum(1, family), (place - base) / np.repeat(sizes, sizes), nodes / np.maximum(1, chars)],
        1,
    )
    bits = lambda name: np.unpackbits(np.frombuffer(b"".join([x.to_bytes(WIDE // 8, "little") for p in pages for x in getattr(p, name)]), np.uint8).reshape(n, WIDE // 8), axis=1, bitorder="little")
    return np.concatenate([dense, bits("token")[:, : len(TOKENS)], bits("above")[:, : len(TOKENS)]], 1).astype(np.float32), starts


class Boosted:
    """Gradient-boosted trees of fixed depth with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.4, bins: int = 32, ridge: float = 2.0):
        self.depth, self.rate = depth, rate
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T)], 1)
        f = x.shape[1]
        cell = binned + bins * np.arange(f)
        p = np.average(y, weights=weight)
        self.bias = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.bias)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-z))
            g, h = weight * (y - prob), weight * prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                base = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(node == base + k)
                    if len(rows) < 20:
                        continue
                    sums = [np.bincount(cell[rows].ravel(), np.repeat(v[rows], f), f * bins).reshape(f, bins).cumsum(1) for v in (g, h)]
                    (gl, hl), (gt, ht) = sums, (s[0, -1] for s in sums)
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    best = int(np.argmax(gain))
                    j, b = best // bins, best % bins
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        feature[base + k], cut[base + k] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            at = node - (2**depth - 1)
            leaf = np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
            z += rate * leaf[at]
            self.feature.append(feature)
            self.cut.append(cut.astype(np.float32))
            self.leaf.append(leaf)

    def odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += self.rate * leaf[node - (2**self.depth - 1)]
        return z


def written_page(rng: np.random.Generator) -> str:
    """A page for training, in whose source article text is written in capitals and all other text in small letters."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    line = lambda a, b: words(a, b) + rng.choice([".", "", "!", "?"], p=[0.7, 0.2, 0.05, 0.05])
    told = rng.random() < 0.75  # whether tags and names tell

    def part(kind: str, inner: str) -> str:
        tag = kind if kind in TAGS and rng.random() < 0.6 and told else rng.choice(["div", "section", "div"])
        name = rng.choice(["", word(), kind, f"{kind}-{word()}", f"{word()} {kind}", f"{kind}_box"], p=[0.1, 0.1, 0.4, 0.2, 0.1, 0.1]) if told else rng.choice(["", word()])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links(n: int) -> str:
        one = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in one)}</ul>" if rng.random() < 0.7 else " ".join(one)

    def prose(a: int, b: int) -> str:
        s = " ".join(line(3, 14) for _ in range(rng.integers(a, b)))
        if rng.random() < 0.2:
            s = f"<{(t := rng.choice(['b', 'em', 'strong', 'span']))}>{s}</{t}> {line(2, 6)}"
        if rng.random() < 0.15:
            s += f' <a href="/{word()}">{words(1, 4)}</a> {line(2, 8)}'
        return s

    def noise(kind: str) -> str:
        if kind in ("nav", "menu", "breadcrumb", "pagination", "related", "social", "share", "tags"):
            return part(kind, links(rng.integers(2, 12)))
        if kind in ("comments", "comment", "discussion"):
            return part(kind, "".join(part("comment", f"<p>{prose(1, 4)}</p>" if rng.random() < 0.7 else prose(1, 3)) for _ in range(rng.integers(1, 5))))
        if kind in ("form", "newsletter", "subscribe", "login", "search"):
            return part(kind, f"<form><label>{words(1, 4)}</label><input type=text><button>{words(1, 3)}</button></form>")
        if kind in ("sidebar", "aside", "widget"):
            return part(kind, f"<h3>{words(1, 4)}</h3>" + (links(rng.integers(2, 8)) if rng.random() < 0.6 else f"<p>{prose(1, 3)}</p>"))
        if kind in ("sidebar", "footer", "menu", "related") and rng.random() < 0.1:  # links in a table
            return part(kind, f"<table>{''.join(f'<tr><td>{links(1)}</td></tr>' for _ in range(rng.integers(2, 6)))}</table>")
        if kind in ("footer", "copyright", "legal"):
            return part(kind, rng.choice([f"&copy; {words(2, 9)}", f"<p>{prose(1, 3)}</p>{links(3)}", line(3, 12)]))
        if kind == "header":
            return part(kind, f"<h2>{words(1, 5)}</h2>{links(rng.integers(0, 5)) if rng.random() < 0.5 else ''}")
        return part(kind, rng.choice([line(2, 10), f"<p>{prose(1, 3)}</p>", f'<a href="/{word()}">{words(1, 6)}</a>']))

    def cells() -> str:
        head = f"<tr>{''.join(f'<th>{words(1, 3)}</th>' for _ in range(wide))}</tr>" if (wide := int(rng.integers(2, 5))) and rng.random() < 0.6 else ""
        value = lambda: str(rng.integers(0, 9999)) + rng.choice(["", "", "%", ".5"]) + words(0, 2) if rng.random() < 0.4 else words(1, 4)
        rows = "".join(f"<tr>{''.join(f'<td>{value()}</td>' for _ in range(wide))}</tr>" for _ in range(rng.integers(1, 7)))
        rows = f"<thead>{head}</thead><tbody>{rows}</tbody>" if head and rng.random() < 0.4 else head + rows
        return f"<table>{f'<caption>{words(1, 5)}</caption>' if rng.random() < 0.2 else ''}{rows}</table>"

    def code() -> str:
        lines = "\n".join("  " * rng.integers(0, 3) + words(1, 3) + rng.choice(["();", " = 1", " {", "}", ":", ""]) for _ in range(rng.integers(1, 8)))
        return rng.choice([f"<pre>{lines}</pre>", f"<pre><code>{lines}</code></pre>", f"<div><pre><code>{lines}</code></pre></div>"])

    def figure() -> str:
        return f'<figure><img src="/{word()}.png"><figcaption>{line(2, 12)}</figcaption></figure>'

    def terms() -> str:
        return f"<dl>{''.join(f'<dt>{words(1, 3)}</dt><dd>{line(2, 10)}</dd>' for _ in range(rng.integers(1, 5)))}</dl>"

    few = lambda kinds, lo, hi: "".join(noise(k) for k in rng.choice(kinds, rng.integers(lo, hi)))
    blocks = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if rng.random() < 0.16:
            blocks.append([cells, code, figure, terms][rng.integers(4)]())
        elif kind < 0.75:
            blocks.append(rng.choice([f"<p>{prose(1, 9)}</p>", f"<p>{line(1, 5)}</p>", f"<p><b>{prose(1, 5)}<br>"], p=[0.75, 0.15, 0.1]))
        elif kind < 0.82:
            blocks.append(f"<h2>{words(1, 7)}</h2>")
        elif kind < 0.88:
            blocks.append(f"<ul>{''.join(f'<li>{line(2, 14)}</li>' for _ in range(rng.integers(2, 6)))}</ul>" if rng.random() < 0.7 else f"<ol>{''.join(f'<li><p>{prose(1, 3)}</p></li>' for _ in range(rng.integers(2, 5)))}</ol>")
        elif kind < 0.93:
            blocks.append(f"<blockquote>{prose(1, 4)}</blockquote>")
        else:
            blocks.append(f"<p>{line(1, 4)}</p>")
    blocks = [re.sub(r">[^<]+", lambda m: m[0].upper(), b) for b in blocks]
    bad = [b for b in BAD if b not in ("header", "footer", "byline", "toolbar")]
    inside = rng.random() < 0.35
    article = "".join(b + (few(["ad", "advert", "share", "related", "promo", "newsletter"], 0, 2) if inside else "") for b in blocks)
    article = part(str(rng.choice(GOOD[:6])), article)
    if rng.random() < 0.4:
        article = part(str(rng.choice(["main", "content", "body"])), article + few(["comments", "related", "share", "sidebar"], 0, 3))
    top = few(["nav", "menu", "header", "ad", "notice", "cookie", "breadcrumb", "banner", "search"], 1, 5)
    return f"<html><head><title>{words(2, 6)}</title></head><body>{top}{article}{few(bad, 0, 4)}{noise('footer') if rng.random() < 0.8 else ''}</body></html>"


def fitted(pages: int = 400, seed: int = 11) -> Boosted:
    """The model, learned from generated pages."""
    rng = np.random.default_rng(seed)
    made = [Page(written_page(rng)) for _ in range(pages)]
    x, _ = describe(made)
    y, w = [], []
    for p in made:
        big, small = [0] * len(p.tag), [0] * len(p.tag)
        for t in p.text:
            if t is not None:
                big[t[0]] += sum(c.isupper() for c in t[1])
                small[t[0]] += sum(c.islower() for c in t[1])
        y += [int(b > s) for b, s in zip(big, small)]
        w += [1.0 if b + s else 0.0 for b, s in zip(big, small)]
    y, w = np.array(y, float), np.array(w)
    own = w > 0
    return Boosted(x[own], y[own], w[own])


def main_text(page: Page, odds: np.ndarray) -> str:
    """The text of the best set of elements that is closed under parents, and in which words set off inside a line go with it."""
    gain = odds * np.log1p(page.own)
    gain = np.where(np.array(page.own) > 0, gain, 0.0).tolist()
    parent = page.parent
    with_block = [page.tag[i] in INLINE and page.token[i] in (0, 1 << TOKENS.get(page.tag[i], 0)) and page.own[parent[i]] > 0 for i in range(len(parent))]
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0 or with_block[i]:
            gain[parent[i]] += gain[i]
    keep = [False] * len(parent)
    keep[0] = gain[0] > 0
    for i in range(1, len(parent)):
        keep[i] = (gain[i] > 0 or with_block[i]) and keep[parent[i]]
    blocks, now = [], []
    own = page.own
    for t in [*page.text, None]:
        if t is None:
            if now and (joined := " ".join("".join(now).split())):
                blocks.append(joined)
            now = []
        elif keep[t[0]] or (not own[t[0]] and t[1] == " "):
            now.append(t[1])
    return "\n".join(blocks)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars of every page; a narrow stage over the model that the driver fits."""
    model = fitted()
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__html", 2 << 20):
            n = b.num_columns - 1
            pages = [Page(x or "") for x in b.column(n).to_pylist()]
            x, starts = describe(pages)
            odds = model.odds(x)
            text = [main_text(p, odds[starts[i] : starts[i + 1]]) for i, p in enumerate(pages)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    src = df.selectExpr(*[f"`{c}`" for c in keep], f"`{html_col}` AS __html")
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
