"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks of text in order, each with the tags, classes and roles above it. Features of ancestors and
of the text score a block as main text or not, transitions score neighbours, and Viterbi decodes the page. Weights are
trained by gradient ascent on the exact likelihood (forward-backward) of labelled pages.

Labelled pages are HTML in which elements of the main text carry ``data-main``; features never see that attribute.
``labelled_pages`` makes a varied training set by rule; ``train`` takes any other.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of

#: Labelled pages that the model is fitted on by default.
TRAINING_PAGES = 600

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style template noscript head title svg math iframe object textarea select button option canvas audio video map".split())
RAW = frozenset("script style textarea title".split())
#: Open elements of the first kind end where one of the second begins.
ENDS_P = BLOCK - {"html", "body", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What leaves an open head open; anything else ends it.
IN_HEAD = frozenset("html head title meta link base basefont bgsound style script noscript template".split())
SCOPES = frozenset("article aside blockquote body details div dl fieldset figure footer form header html li main menu nav ol section table td th ul".split())

#: Parts of classes, ids and roles that count as features.
HINTS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie consent gdpr notice alert "
    "nav navigation menu navbar breadcrumb breadcrumbs toc sidebar side aside widget related recommended more tags tag share sharing social follow "
    "footer foot header head masthead top bottom copyright legal comment comments reply replies discussion disqus respond form search login signup "
    "subscribe subscription newsletter pagination pager hidden complementary contentinfo "
    "content main article post entry story body text page single hentry prose caption byline author meta date title headline lead summary".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDE = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _hints(attributes: str) -> frozenset[str]:
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    out = {w.lower() for value in _NAMED.findall(attributes) for w in _PARTS.findall(value)} & HINTS
    return frozenset(out | ({"hidden"} if _HIDE.search(attributes) else set()))


class Above(NamedTuple):
    """What features tell of the elements above a place: all of them, however many, in a few small sets."""

    tags: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()
    leaf: str = ""
    own: frozenset[str] = frozenset()
    depth: int = 0  # up to DEEP

    def below(self, tag: str, hints: frozenset[str]) -> Above:
        """The same one element further down; inline elements without hints don't count."""
        if tag not in BLOCK and not hints:
            return self
        tags = self.tags if tag in self.tags or tag not in BLOCK else self.tags | {tag}
        return Above(tags, self.hints if hints <= self.hints else self.hints | hints, tag if tag in BLOCK else "inline", hints, min(DEEP, self.depth + 1))


#: Elements from which on a place is deep.
DEEP = 7


def blocks(page: str | None) -> list[tuple[str, Above, int, bool]]:
    """(text, what is above it, characters in links, labelled) of each leaf block."""
    page, out = page or "", []
    stack: list[tuple[str, Above, bool]] = []  # with what is above the content of each open element, and whether that is labelled
    opened: Counter[str] = Counter()  # tags of the stack
    parts: list[str] = []
    linked, unseen, at, n = 0, 0, 0, len(page)

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1] if stack else Above(), linked, bool(stack) and stack[-1][2]))
            parts, linked = [], 0

    def pop_to(k: int):
        nonlocal unseen
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag] -= 1
            unseen -= tag in UNSEEN

    def end_head(tag: str):
        """An open head ends at a body, and at what can't stand in it."""
        if opened["head"] and (tag == "body" or stack[-1][0] == "head"):
            close()
            pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "head"))

    def add(text: str):
        nonlocal linked
        if text.strip():
            end_head("")
        if text and not unseen:
            parts.append(text)
            if opened["a"]:
                linked += len(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag not in IN_HEAD and not slash:
            end_head(tag)
        if tag == "br":
            add("\n")
            continue
        if slash:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1) if opened[tag] else -1
            if tag in BLOCK:
                close()
            if k >= 0 and (tag in SCOPES or not any(stack[j][0] in SCOPES for j in range(k + 1, len(stack)))):
                pop_to(k)
            continue
        if tag in BLOCK:
            close()
        if tag in ENDS_P:  # an open paragraph ends, and what was left open in it
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SCOPES), -1)
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        if tag in ENDS_SAME:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS_SAME[tag] or stack[k][0] in ("ul", "ol", "dl", "table", "div")), -1)
            if k >= 0 and stack[k][0] in ENDS_SAME[tag]:
                pop_to(k)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        above, labelled = stack[-1][1:] if stack else (Above(), False)
        stack.append((tag, above.below(tag, _hints(attributes)), labelled or "data-main" in attributes))
        opened[tag] += 1
        unseen += tag in UNSEEN
    close()
    return out


def _path_features(above: Above) -> list[str]:
    out = ["bias", *(f"in:{t}" for t in above.tags), *(f"hint:{h}" for h in above.hints)]
    if above.leaf:
        out += [f"leaf:{above.leaf}", *(f"own:{h}" for h in above.own)]
        out.append("deep" if above.depth == DEEP else "shallow")
    if not above.tags & {"article", "main"}:
        out.append("no-article")
    elif above.tags & {"nav", "footer", "aside", "form", "header"}:
        out.append("inner-frame")
    return sorted(out)


def _text_features(text: str, linked: int, k: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    out = [f"words:{min(7, words.bit_length())}", f"links:{min(3, int(4 * linked / max(1, len(text))))}", f"place:{min(3, 4 * k // max(1, n))}"]
    if text[-1] in ".!?\"'»”…:":
        out.append("ends")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if "." in text[:-1] or "," in text:
        out.append("points")
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    return out


_WORDS = "river stone market paper light winter garden letter table window morning bridge silver story engine forest number water signal market copper valley minor change report simple quiet early people answer common".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[str]:
    """Pages made by rule: many layouts, with all kinds of frame round and inside the main text, some badly closed or cut off."""
    r = random.Random(seed)
    say = lambda a, b, end=".": " ".join(r.choice(_WORDS) for _ in range(r.randint(a, b))).capitalize() + end
    pick = lambda *x: r.choice(x)
    some = lambda p, s: s() if r.random() < p else ""
    li = lambda k, a=1, b=3: "".join(f'<li><a href="/x">{say(a, b, "")}</a></li>' for _ in range(k))
    short = lambda: say(3, 14, pick(".", "", "!"))
    nav = lambda: pick(lambda: f"<nav><ul>{li(r.randint(3, 9))}</ul></nav>", lambda: f'<div class="{pick("menu", "navbar", "top-nav", "breadcrumbs")}">' + " | ".join(f'<a href="#">{say(1, 2, "")}</a>' for _ in range(5)) + "</div>", lambda: f'<ul id="{pick("menu", "nav")}">{li(5)}</ul>')()
    advert = lambda: f'<{(t := pick("div", "aside", "section", "p"))} class="{pick("ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-box")}">{pick(short, lambda: "<p>" + short() + "</p>", lambda: say(8, 40))()}</{t}>'
    notice = lambda: f'<div {pick("class", "id")}="{pick("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup")}"><p>{say(6, 30)}</p>{some(0.5, lambda: "<button>" + say(1, 2, "") + "</button>")}</div>'
    head = lambda: f'<header>{pick(lambda: "<h1>" + say(1, 4, "") + "</h1>", lambda: "<p>" + say(2, 8) + "</p>", lambda: "<a href=/>" + say(1, 3, "") + "</a>")()}{some(0.4, nav)}</header>'
    foot = lambda: f'<{(t := pick("footer", "footer", "div"))}{"" if t == "footer" else pick(" class=footer", " id=copyright")}>{pick("&copy; ", "Copyright ", "")}{say(1, 3, "")} &middot; {say(4, 16)}</{t}>'
    side = lambda: f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "widget", "side related", "related")}"><h3>{say(1, 3, "")}</h3>{pick(lambda: "<ul>" + li(5, 3, 9) + "</ul>", lambda: "<p>" + say(10, 40) + "</p>")()}</{t}>'
    form = lambda: f'<form><label>{say(1, 3, "")}</label><input name=q>{some(0.6, lambda: "<p>" + say(4, 18) + "</p>")}<button>{say(1, 1, "")}</button></form>'
    comments = lambda: f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "replies", "discussion")}">' + "".join(f'<{(u := pick("div", "li", "article"))} class="{pick("comment", "reply")}"><b>{say(1, 2, "")}</b><p>{say(4, 60)}</p></{u}>' for _ in range(r.randint(1, 5))) + f"</{t}>"
    share = lambda: f'<div class="{pick("share", "social", "tags")}">' + " ".join(f"<a href=#>{say(1, 1, '')}</a>" for _ in range(4)) + "</div>"

    def main() -> str:
        wrap = pick("article", "article", "article", "main", "div", "div", "section")
        named = pick("", "", ' class="post"') if wrap in ("article", "main") else f' {pick("class", "id")}="{pick("content", "entry-content", "post body", "story", "article-text", "main")}"'
        inner = []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.68:
                p = pick(lambda: say(8, 90), lambda: say(1, 4), lambda: " ".join(say(4, 25) for _ in range(r.randint(2, 6))), lambda: f"<b>{say(3, 12)}</b> {say(5, 40)}", lambda: f'{say(5, 20, "")} <a href="/y">{say(1, 4, "")}</a> {say(3, 20)}', lambda: f"<b>{say(4, 20)}<br>")()
                inner.append(f"<p data-main>{p}" + some(0.9, lambda: "</p>"))
            elif kind < 0.76:
                inner.append(f"<{(h := pick('h2', 'h3'))} data-main>{say(1, 7, '')}</{h}>")
            elif kind < 0.83:
                inner.append(f"<{(u := pick('ul', 'ol'))} data-main>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{u}>")
            elif kind < 0.88:
                inner.append(f"<blockquote data-main><p>{say(5, 30)}</p></blockquote>")
            elif kind < 0.91:
                inner.append("<table data-main>" + "".join(f"<tr><td>{say(1, 3, '')}</td><td>{say(1, 5, '')}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                inner.append(f"<pre data-main>{say(4, 20, '')}</pre>")
            else:
                inner.append(pick(advert, advert, share, form, notice)())
        title = f"<h1 data-main>{say(2, 12, pick('', '.'))}</h1>"
        title = pick(title, title, title, f"<header data-main>{title}</header>" if wrap == "article" else title, "")
        return f"<{wrap}{named}>{title}{''.join(inner)}{some(0.15, comments)}{some(0.1, share)}</{wrap}>"

    pages = []
    for _ in range(n):
        before = [x for x in (some(0.35, head), some(0.8, nav), some(0.4, advert), some(0.2, notice), some(0.15, side), some(0.15, form)) if x]
        after = [x for x in (some(0.25, comments), some(0.3, side), some(0.2, advert), some(0.15, form), some(0.8, foot), some(0.15, notice)) if x]
        r.shuffle(before)
        body = "".join(before) + main() + "".join(after)
        page = f"<!DOCTYPE html><html><head><title>{say(2, 8, '')}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{some(0.3, lambda: '<div class=page>')}{body}" + some(0.85, lambda: "</body></html>")
        pages.append(page)
    return pages


class Model:
    """Weights of main text against the rest by feature, and of label pairs (from, to)."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs, self.seen = weights, pairs, {}

    def _of(self, above: Above) -> float:
        if (x := self.seen.get(above)) is None:
            if len(self.seen) > 20_000:
                self.seen.clear()
            x = self.seen[above] = sum(self.weights.get(f, 0.0) for f in _path_features(above))
        return x

    def decode(self, page_blocks: list) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        n = len(page_blocks)
        if not n:
            return []
        get = self.weights.get
        (t00, t01), (t10, t11) = self.pairs.tolist()
        a = b = 0.0
        back = []
        for k, (text, path, linked, _) in enumerate(page_blocks):
            e = self._of(path) + sum(get(f, 0.0) for f in _text_features(text, linked, k, n))
            if not k:
                a, b = 0.0, e
                continue
            from0, from1 = b + t10 > a + t00, b + t11 >= a + t01
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + e
        out = [b >= a]
        for from0, from1 in reversed(back):
            out.append(from1 if out[-1] else from0)
        return out[::-1]


def train(pages: list[str], steps: int = 150, l2: float = 0.02) -> Model:
    """Maximum likelihood with a small ridge, by Adam from zero; the same pages give the same model."""
    seqs = [b for b in map(blocks, pages) if b]
    names: dict[str, int] = {}
    rows = [[names.setdefault(f, len(names)) for f in _path_features(p) + _text_features(t, ln, k, len(s))] for s in seqs for k, (t, p, ln, _) in enumerate(s)]
    gold = np.array([m for s in seqs for *_, m in s], int)
    sizes = np.array([len(s) for s in seqs])
    N, T = len(seqs), int(sizes.max())
    page_of, place = np.repeat(np.arange(N), sizes), np.concatenate([np.arange(k) for k in sizes])
    there = np.arange(T)[None, :] < sizes[:, None]
    y = np.zeros((N, T), int)
    y[page_of, place] = gold
    flat, own = np.array([f for x in rows for f in x]), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    d = len(names)
    x, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    both = there[:, 1:]
    seen_pairs = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4).astype(float)
    for t in range(1, steps + 1):
        e = np.zeros((N, T, 2))
        e[page_of, place, 1] = np.bincount(own, weights=x[flat], minlength=len(rows))
        trans = x[d:].reshape(2, 2)
        alpha, beta = np.zeros((N, T, 2)), np.zeros((N, T, 2))
        alpha[:, 0] = e[:, 0]
        for k in range(1, T):
            step = np.logaddexp(alpha[:, k - 1, :1] + trans[0], alpha[:, k - 1, 1:] + trans[1]) + e[:, k]
            alpha[:, k] = np.where(there[:, k, None], step, alpha[:, k - 1])
        for k in range(T - 2, -1, -1):
            nxt = beta[:, k + 1] + e[:, k + 1]
            step = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
            beta[:, k] = np.where(there[:, k + 1, None], step, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        pair = alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        expected = np.exp(np.where(both[:, :, None, None], pair, -np.inf)).sum((0, 1)).reshape(4)
        g = np.concatenate((np.bincount(flat, weights=(p1[page_of, place] - gold)[own], minlength=d), expected - seen_pairs)) / N + l2 * x / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(x[k]) for f, k in names.items()}, x[d:].reshape(2, 2).copy())


def extract(page: str | None, model: Model) -> str:
    own = blocks(page)
    return " ".join(b[0] for b, keep in zip(own, model.decode(own)) if keep)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null or empty html, and a page without main text, give an empty text. Repeated rows give repeated rows, an empty table
    none; other columns are ignored. Pages are read whole, however long and however deep their elements lie: features of
    all elements above a block are kept as small sets. Of two equally likely labellings the one that keeps more of the
    page's end is taken. ``model`` defaults to one trained on ``labelled_pages()``.
    """
    model = model or train(labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.pairs.tolist()))  # some hundred numbers; plain, so workers need no package

    def run(batches):
        weights, pairs = sent.value
        model = Model(weights, np.array(pairs))
        for part in rows_of(batches, 500, 8 << 20):
            texts = [extract(h, model) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
