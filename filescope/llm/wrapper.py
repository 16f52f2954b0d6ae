"""HTML extraction by wrapper induction over pages of the same host.

Trees of a host's pages are aligned by simple tree matching and merged into one wrapper: neighbours of the same element are
one repeated node, and each node remembers whether its text is constant or varies.  Constant nodes are template.  The slot of
the content is the lowest node outside of which all text is template or says by its element, class, id or role that it is a
menu, an advert or the like, for these vary as well; where several nodes vary, the one with the article is it.

Inside the slot little is left out: what is template, elements that hold no text of an article (SLOT_TAGS), blocks whose whole
class, id or role is such a name, and blocks that have one as a part of theirs only if the alignment finds them on most
pages of the host and they consist of links.  A page's text is read along its alignment.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm.common import batched, kept, stored, table, worker
from filescope.llm.html_dom import INLINE, RAW, Node, clean, parse

#: Elements, class words and roles of what is not the article.  Headers are a site's outside of the slot only.
SLOT_TAGS = frozenset("head nav footer aside form button select option input dialog menu svg canvas".split()) | RAW
NOISE_TAGS = SLOT_TAGS | {"header"}
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|login|nav\w*|menu\w*"
    r"|breadcrumbs?|side-?bar|footer|masthead|topbar|toolbar|comments?|comment-?list|replies|disqus|related|recommend\w*|share\w*|sharing|social|widgets?|popup|modal"
    r"|navigation|contentinfo|complementary|search|dialog|pagination|pager|skip-link|copyright)(?:$|[\s_-])"
)
#: Whole names that say what a block inside an article is.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adsbygoogle ad-box ad-slot ad-banner ad-container ad-wrapper sponsor sponsored promo promotion banner"
    " cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice alert newsletter newsletter-signup subscribe signup login nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar side-bar footer site-footer site-header masthead topbar toolbar comment comments comment-list comment-section comments-section user-comments"
    " reader-comments replies disqus disqus_thread related-posts related-articles recommended share-this share-buttons share-bar social social-links widget popup modal pagination pager"
    " contentinfo complementary search dialog skip-link".split()
)
ANCHOR = re.compile(r"(?:^|\s)#\S*")
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that are text of the content and never all of it.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote".split())
#: Pages of different text that a constant node needs, and the share of them that must agree, before it counts as template.
LEAST_PAGES, AGREED = 5, 0.8
#: Of the characters of a block that are links, from which on it is a list of links.
LINKS = 0.5
#: Hosts whose wrappers may be broadcast, a few hundred bytes each.
BROADCAST_HOSTS = 20_000
FLUSH_HOSTS = 4_000
#: Children of a wrapper's node; beyond, those of one signature become one node.  Bounds wrappers, not texts.
CHILDREN = 200
#: Levels of a wrapper; what is deeper is text of its lowest node.  Bounds wrappers: pages are read to any depth.
DEPTH = 200
SALTS = 32


class Wrapper:
    """A merged node: sig, pages n, of which the text `said` (a hash) in `same`; varying characters; children in order."""

    __slots__ = ("sig", "n", "said", "same", "chars", "children")

    def __init__(self, sig: str, n: int = 0, said: int = 0, same: int = 0, chars: int = 0, children: list[Wrapper] | None = None):
        self.sig, self.n, self.said, self.same, self.chars, self.children = sig, n, said, same, chars, children or []

    def dump(self) -> list:
        return [self.sig, self.n, self.said, self.same, self.chars, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, x: list) -> Wrapper:
        return cls(*x[:5], [cls.load(c) for c in x[5]])


def signature(node: Node) -> str:
    return f"{node.tag}.{re.sub(r'[0-9]+', '0', node.mark)}" if node.mark else node.tag


def noise(sig: str) -> bool:
    """Whether a node outside of the slot is no content, whatever it says."""
    tag, _, mark = sig.partition(".")
    return tag in NOISE_TAGS or bool(mark and NOISE_WORDS.search(ANCHOR.sub("", mark) if "#" in mark else mark))


def noise_inside(sig: str) -> bool:
    """Whether a node inside an article is no part of it, by its element or by a whole name."""
    tag, _, mark = sig.partition(".")
    return tag in SLOT_TAGS or any(word in NAMES for word in mark.split())


def noisy(node: Node) -> bool:
    return noise(signature(node))


def blocks_of(node: Node, dropped: Callable[[Node], bool], muted: Callable[[Node], bool] | None = None) -> list[str]:
    """The blocks of text below a node in page order.  Blocks end where a block element begins or ends.

    A block that dropped holds for is left out; one that muted holds for loses its own text, not the blocks inside.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            s = clean(run)
            if s:
                out.append(s)
            run.clear()

    below = [(iter(node.children), False, True)]
    while below:
        rest, mute, block = below[-1]
        for c in rest:
            if isinstance(c, str):
                if not mute:
                    run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif c.tag in INLINE:
                below.append((iter(c.children), mute, False))
                break
            else:
                flush()
                if not dropped(c):
                    below.append((iter(c.children), bool(muted and muted(c)), True))
                    break
        else:
            below.pop()
            if block:
                flush()
    return out


def _own(node: Node, whole: bool = False) -> tuple[str, list[Node]]:
    """A node's own text, inline elements included, and the block elements that stand in it; or whole: all text below."""
    said: list[str] = []
    blocks: list[Node] = []
    below = [iter(node.children)]
    while below:
        for c in below[-1]:
            if isinstance(c, str):
                said.append(c)
            elif c.tag in INLINE or whole and c.tag not in RAW:
                below.append(iter(c.children))
                break
            else:
                blocks.append(c)
        else:
            below.pop()
    return clean(said), blocks


def links(node: Node) -> bool:
    """Whether links make up the better part of what a node says."""
    inside, every = 0, 0
    below = [(iter(node.children), node.tag == "a")]
    while below:
        for c in below[-1][0]:
            if isinstance(c, str):
                n = sum(map(len, c.split()))
                every += n
                inside += n if below[-1][1] else 0
            elif c.tag not in RAW:
                below.append((iter(c.children), below[-1][1] or c.tag == "a"))
                break
        else:
            below.pop()
    return inside >= LINKS * every


def as_wrapper(node: Node, level: int = 0) -> Wrapper:
    """A page as a wrapper of one page.  Neighbouring elements of one signature become one node; inline ones are text."""
    sig = signature(node)
    w = Wrapper(sig, 1)
    if noise(sig):
        return w  # it tells nothing about where the content is
    text, blocks = _own(node, whole=level >= DEPTH)
    folded: list[Wrapper] = []
    for c in blocks if level < DEPTH else []:
        x = as_wrapper(c, level + 1)
        if folded and folded[-1].sig == x.sig:
            folded[-1] = _repeated(folded[-1], x)
        else:
            folded.append(x)
    w.children = _bounded(folded, _repeated)
    w.said, w.same, w.chars = zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0, 1, len(text)
    return w


def _repeated(a: Wrapper, b: Wrapper) -> Wrapper:
    """Two nodes of one page as one: what it says is what they say in turn."""
    out = merge(a, b)
    out.n, out.same, out.said = 1, 1, zlib.crc32(f"{a.said} {b.said}".encode())
    return out


def _bounded(children: list[Wrapper], both) -> list[Wrapper]:
    if len(children) <= CHILDREN:
        return children
    out: dict[str, Wrapper] = {}
    for c in children:
        out[c.sig] = both(out[c.sig], c) if c.sig in out else c
    return list(out.values())


def _match(a: list[Wrapper], b: list[Wrapper]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-preserving pairing of equal signatures with the most matched nodes."""
    if [x.sig for x in a] == [x.sig for x in b]:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > CHILDREN * CHILDREN:  # many different signatures: each node with the next of its own
        out, j, places = [], 0, {x.sig: i for i, x in reversed(list(enumerate(b)))}
        for i, x in enumerate(a):
            k = places.get(x.sig, -1)
            if k >= j:
                out.append((i, k))
                j = k + 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + _size(a[i], b[j]) if a[i].sig == b[j].sig else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if best[i][j] == best[i + 1][j]:
            i += 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def _size(a: Wrapper, b: Wrapper) -> int:
    """Matched nodes of two trees of equal signature."""
    return 1 + sum(_size(a.children[i], b.children[j]) for i, j in _match(a.children, b.children))


def merge(a: Wrapper, b: Wrapper) -> Wrapper:
    """One wrapper for the pages of both.  Nodes of one side only stay at their place between the matched ones.

    The commonest text is kept by majority vote: votes for another text take votes away.
    """
    children, i, j = [], 0, 0
    for x, y in [*_match(a.children, b.children), (len(a.children), len(b.children))]:
        children += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            children.append(merge(a.children[x], b.children[y]))
        i, j = x + 1, y + 1
    if a.said == b.said:
        said, same = a.said, a.same + b.same
    else:
        said, same = (a.said, a.same - b.same) if a.same >= b.same else (b.said, b.same - a.same)
    return Wrapper(a.sig, a.n + b.n, said, same, a.chars + b.chars, _bounded(children, merge))


def template(w: Wrapper, pages: int) -> bool:
    """A node that says the same on nearly all pages, of enough pages.  same counts a majority's lead."""
    return bool(w.said) and pages >= LEAST_PAGES and w.n >= AGREED * pages and w.same >= (2 * AGREED - 1) * w.n


def _varying(w: Wrapper, pages: int, all_agree: bool = False) -> int:
    """Characters below that are neither noise nor template; with all_agree, of template that some page says otherwise as well."""
    if noise(w.sig):
        return 0
    fixed = template(w, pages) and (not all_agree or w.same == w.n)
    return (0 if fixed else w.chars) + sum(_varying(c, pages, all_agree) for c in w.children)


def content_slot(w: Wrapper, pages: int) -> list[str]:
    """Signatures on the way from the root to the slot of the content.

    Alignment leads: to the child that holds all text which is neither noise nor the same on every page.  Where several hold
    some, the one that has an article below is taken, and else the slot is their parent.  An article is never left for a part
    of it.
    """
    path, at = [], w
    while at.sig.partition(".")[0] != "article":
        said = [(_varying(c, pages, all_agree=True), c) for c in at.children if not noise(c.sig)]
        said = [x for x in said if x[0]]
        own = at.chars if not (template(at, pages) and at.same == at.n) else 0
        main = [x for x in said if _has_article(x[1], pages)]
        if len(main) == 1:
            best = main[0][1]
        elif len(said) == 1 and not own and at.sig.partition(".")[0] != "main" and said[0][1].sig.partition(".")[0] not in TEXT_TAGS:
            best = said[0][1]
        else:
            return path
        path.append(best.sig)
        at = best
    return path


def _has_article(w: Wrapper, pages: int) -> bool:
    """Whether half of the pages have an article there."""
    return not noise(w.sig) and 2 * w.n >= pages and (w.sig.partition(".")[0] in MAIN_TAGS or any(_has_article(c, pages) for c in w.children))


def rules(w: Wrapper) -> dict:
    """What extraction needs of a wrapper: the slot's path, hashes of constant blocks inside, and signatures there that have
    a name of noise as part of theirs and stand on most pages."""
    path = content_slot(w, w.n)
    at = w
    for sig in path:
        at = next(c for c in at.children if c.sig == sig)
    const: list[tuple[str, int]] = []
    marked: set[str] = set()
    below = list(at.children)
    while below:
        x = below.pop()
        if noise(x.sig):
            if w.n >= LEAST_PAGES and x.n >= AGREED * w.n:
                marked.add(x.sig)
            continue
        if template(x, w.n):
            const.append((x.sig, x.said))
        below += x.children
    return {"path": path, "const": sorted(const), "marked": sorted(marked)}


def extract(page: Node, rule: dict) -> str:
    """The page's text in its slot; of a page without it, below its own article or all of it.

    Outside of articles what has a name of noise is left out as well: children of a slot that is no article, and all of a page
    that has neither a slot nor an article.
    """
    const, marked = {(s, h) for s, h in rule["const"]}, set(rule.get("marked", ()))
    sigs = {s for s, _ in const}

    def same(n: Node) -> bool:
        if not const:
            return False
        sig = signature(n)
        if sig not in sigs:
            return False
        text = _own(n)[0]
        return bool(text) and (sig, zlib.crc32(text.encode("utf-8", "surrogatepass"))) in const

    level = [page] if rule["path"] else _articles(page) or [page]
    for sig in rule["path"]:
        below = [c for n in level for c in n.children if isinstance(c, Node) and signature(c) == sig]
        if not below:
            level = _articles(page) or [page]
            break
        level = below
    whole = level == [page]
    outer = set() if whole else {id(c) for n in level if n.tag not in MAIN_TAGS for c in n.children if isinstance(c, Node)}

    def dropped(n: Node) -> bool:
        sig = signature(n)
        return (noise(sig) if whole or id(n) in outer else noise_inside(sig)) or (sig in marked and links(n))

    return "\n\n".join(b for n in level for b in blocks_of(n, dropped, same))


def _articles(page: Node) -> list[Node]:
    """The outermost articles of a page, in its order."""
    out = []
    below = [iter(page.children)]
    while below:
        for c in below[-1]:
            if isinstance(c, Node) and not noisy(c):
                if c.tag in MAIN_TAGS:
                    out.append(c)
                else:
                    below.append(iter(c.children))
                    break
        else:
            below.pop()
    return out


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def main_text(page: Node) -> bytes:
    """A digest of what a page says in its articles, or in all of it where it has none: equal for copies of a page."""
    return hashlib.blake2b("\n".join(b for n in _articles(page) or [page] for b in blocks_of(n, noisy)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def induce(pages: DataFrame) -> DataFrame:
    """(host, rule) of pages (host, html).  Pages of equal main text on a host count once in the whole table, so copies make
    nothing constant; of copies that differ around it the one with the smallest wrapper speaks, whichever task reads it.

    Tasks send one wrapper for each main text they hold, which meet by host and text.  Those tasks merge what they got of a
    host; the wrappers meet by host and salt and then by host, one after the other.
    """
    batched(pages.sparkSession)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            least: dict[tuple[str, bytes], str] = {}
            for host, text in zip(b["host"], b["html"], strict=True):
                page = parse(text)
                key, said = (host, main_text(page)), _said(as_wrapper(page))
                least[key] = min(least.get(key, said), said)
            yield pd.DataFrame([(h, m, w) for (h, m), w in least.items()], columns=["host", "main", "wrapper"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}
        for b in batches:
            for host, said in zip(b["host"], b["wrapper"], strict=True):
                w = Wrapper.load(json.loads(said))
                held[host] = merge(held[host], w) if host in held else w
            if len(held) > FLUSH_HOSTS:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def _said(w: Wrapper) -> str:
        return json.dumps(w.dump(), separators=(",", ":"))

    def _rows(held: dict[str, Wrapper]) -> pd.DataFrame:
        return pd.DataFrame([(h, _said(w)) for h, w in held.items()], columns=["host", "wrapper"])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, w = None, None
        for b in batches:
            out = {}
            for host, said in zip(b["host"], b["wrapper"], strict=True):
                x = Wrapper.load(json.loads(said))
                if w is not None and host == now:
                    w = merge(w, x)
                else:
                    if w is not None:
                        out[now] = w
                    now, w = host, x
            if out:
                yield _rows(out)
        if w is not None:
            yield _rows({now: w})

    def ruled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "rule": [json.dumps(rules(Wrapper.load(json.loads(w)))) for w in b["wrapper"]]})

    schema = "host string, wrapper string"
    # sorted aggregation, first in the task that reads: of a repeated page each task sends one row
    distinct = pages.mapInPandas(worker(told, "wrapper"), "host string, main binary, wrapper string").groupBy("host", "main").agg(F.min("wrapper").alias("wrapper"))
    parts = distinct.select("host", "wrapper").mapInPandas(worker(partial, "wrapper"), schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").select("host", "wrapper").mapInPandas(worker(met, "wrapper"), schema)
    whole = parts.repartition("host").sortWithinPartitions("host").mapInPandas(worker(met, "wrapper"), schema)
    return stored(whole.mapInPandas(worker(ruled, "wrapper"), "host string, rule string"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with `text`, the main text, and `n_chars`.

    Null and empty html give an empty text; pages without a host share one wrapper; repeated rows and null ids are kept.
    """
    batched(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    wrappers = induce(pages.select("host", "html"))
    if wrappers.count() <= BROADCAST_HOSTS:
        wrappers = F.broadcast(wrappers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept("wrapper")
        for b in batches:
            texts = []
            for said, text in zip(b["rule"], b["html"], strict=True):
                if said not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[said] = json.loads(said) if said else {"path": [], "const": []}
                texts.append(extract(parse(text), known[said]))
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.join(wrappers, "host", "left").select("page_id", "url", "html", F.coalesce("rule", F.lit("")).alias("rule")).mapInPandas(worker(run, "wrapper"), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


#: What the pages of the driver's tables say: text of their one article, by its tags; named references that they hold.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, [regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g') for x in regexp_split_to_array(h, '</?(?:p|h1)>')] AS t FROM a),
c AS (SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) for x in t] AS t FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(t, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
