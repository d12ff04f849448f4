"""Main text of web pages by consensus host paths.

Every page's containers are scored by the clean text they hold; each container votes for its path of tags
and generalised classes; Spark adds the votes per host and the winning path is then looked up on every page
of the host and its text extracted. A page without that path falls back on its own best container. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import cut, fits_broadcast, read
from wayline.llm.url_filter import host_of

#: Winning paths (one per host) that are broadcast; beyond, pages and paths are shuffled by host.
MAX_BROADCAST_HOSTS = 200_000
#: Share of a page's best score from which a container votes.
VOTE_SHARE = 0.5

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td blockquote".split())
EXCLUDED = frozenset(
    "aside button datalist dialog footer head header iframe menu nav noscript object script select style svg template textarea".split()
)
EXCLUDED_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Words that begin a class which tells of something elsewhere: "has-sidebar" is no sidebar.
TELLING_WORDS = frozenset("has no not with without".split())
EXCLUDED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
P_CLOSED_BY = BLOCKS - {"dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
#: Elements of which a new one ends an open one, and the elements beyond which it doesn't look.
SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("article aside blockquote body button div footer header html main nav section table td th ul ol li".split())

#: Elements that may stand before the body; any other one, or text, begins it.
HEAD = frozenset("base head html link meta noscript script style template title".split())
#: Blocks at which a stray inline end tag stops looking.
BARRIERS = ("article", "body", "div", "section", "table", "td")
#: Nesting beyond which an element's path is its parent's.
MAX_DEPTH = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "own", "depth", "path", "out", "soft", "comment", "mains", "held", "size", "weight")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        #: The innermost block, itself included.
        self.own: Node = self if tag in BLOCKS or parent is None else parent.own
        classes = sorted({c for c in (re.sub(r"[\d_-]+$|\d+", "", x).strip("-_") for x in attributes.get("class", "").lower().split()) if c})
        if tag in BLOCKS and self.depth <= MAX_DEPTH:
            key = ".".join([tag, *classes])
            self.path = f"{parent.path}/{key}" if parent and parent.path else key
        else:
            self.path = parent.path if parent else ""
        named = [_WORD.findall(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
        words = {w for x in named if x and x[0] not in TELLING_WORDS for w in x}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        role = attributes.get("role", "").lower()
        keep = tag in ("html", "body", "main", "article") and not (tag == "article" and words & COMMENT_WORDS)
        # a tag that is never main text takes its subtree along; a name, a role or a form is judged by what it holds
        self.out = bool(parent and parent.out) or tag in EXCLUDED or hidden
        self.soft = tag == "form" or (not keep and bool(words & EXCLUDED_WORDS or role in EXCLUDED_ROLES))
        self.comment = not keep and bool(words & COMMENT_WORDS)
        self.mains, self.held = False, 0
        self.comment = self.comment or bool(parent and parent.comment and tag != "main")
        self.size = 0
        if tag == "article":
            self.weight = 2.0
        elif tag == "main" or role == "main":
            self.weight = 1.5
        elif tag == "body":
            self.weight = 0.9
        else:
            self.weight = 1.2 if words & MAIN_WORDS else 1.0


def tokens(page: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """(start, end, slash, name, rest) of every tag, comment and declaration; name is None for the last two.

    A tag ends at the first ``>`` outside quotes, or at the first one of all where a quote is left open. Every character is
    looked at a bounded number of times: a tag or declaration that nothing closes leaves the rest as text, and once open quotes
    have cost two passes over the page, they are no longer followed.
    """
    at, length, spent = 0, len(page), 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            m = _COMMENT_END.search(page, at + 4)
            end = m.end() if m else length
            yield at, end, "", None, ""
            at = end
            continue
        m = None if page[at + 1 : at + 2] in ("!", "?") else _NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        first = page.find(">", at)
        if first < 0:  # nothing closes from here on but the end of an open comment
            at = page.find("<!--", at)
            if at >= 0:
                yield at, length, "", None, ""
            return
        if m is None:
            yield at, first + 1, "", None, ""
            at = first + 1
            continue
        stop, end = m.end(), first
        while spent <= 2 * length:
            q = _STOP.search(page, stop)
            if q and q[0] == ">":
                end = q.start()
                break
            stop = page.find(q[0], q.end()) + 1 if q else 0
            if not stop:
                spent += length - at
                break
        end = end if end >= m.end() else first
        yield at, end + 1, m[1], m[2].lower(), page[m.end() : end]
        at = end + 1


def _attributes(rest: str) -> dict[str, str]:
    return {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks (innermost block element, text) in page order outside all that is left out, and all containers.

    An element that is left out for its name, its role or as a form stays in if it holds ``main`` or the page's
    largest article, of a third of the text that is no comment; on a page with no article or ``main``, if it holds more than half
    of that text and is no comment. Themes and server frameworks name and wrap whole pages so.
    """
    root = Node("html", None, {})
    stack, blocks, containers, nodes = [root], [], [], [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    mains: list[Node] = []
    remarks: list[Node] = []
    pending: list[tuple[str, bool]] = []
    body = False

    def flush() -> None:
        if pending:
            text = _SPACE.sub(" ", "".join(t for t, _ in pending)).strip()
            if text:
                linked = sum(len(t) for t, link in pending if link)
                owner = stack[-1].own
                blocks.append((owner, text, max(0, len(text) - linked)))
                owner.held += len(text)
            pending.clear()

    def close(index: int) -> None:
        if any(n.tag in BLOCKS for n in stack[index:]):
            flush()
        for n in stack[index:]:
            places[n.tag].pop()
        del stack[index:]

    def open_(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, stack[-1], attributes)
        places[tag].append(len(stack))
        stack.append(node)
        nodes.append(node)
        if tag in ("article", "main") and not node.out and not node.soft and not node.comment:
            mains.append(node)
        if tag in CONTAINERS and not node.out:
            containers.append(node)
        if node.comment and not node.out and not (node.parent and node.parent.comment):
            remarks.append(node)

    def begin_body(attributes: dict[str, str]) -> None:
        nonlocal body
        body = True
        if places["head"]:
            close(places["head"][0])
        flush()
        open_("body", attributes)

    def text(raw: str) -> None:
        if not body and raw.strip() and stack[-1].tag in ("html", "head"):
            begin_body({})
        if raw and not stack[-1].out:
            pending.append((entities.unescape(raw), bool(places["a"])))

    at, length = 0, len(page)
    skip = 0
    for start, stop, end, tag, rest in tokens(page):
        if start < skip:
            continue
        text(page[at:start])
        at = stop
        if tag is None:
            continue
        if end:
            found = places[tag][-1] if places[tag] else 0
            # a stray inline end tag closes nothing beyond its block
            if found and (tag in BLOCKS or found >= max((places[b][-1] for b in BARRIERS if places[b]), default=0)):
                close(found)
            elif not found and tag in BLOCKS:
                flush()
            continue
        if tag == "html":
            continue
        if tag == "body" and not body:
            begin_body(_attributes(rest))
            continue
        if tag == "body" and places["body"]:
            continue
        if not body and tag not in HEAD and stack[-1].tag in ("html", "head"):
            begin_body({})
        if tag in RAW:
            if tag != "iframe" or not rest.rstrip().endswith("/"):
                ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                closed = page.find(">", ended.end()) if ended else -1
                at = skip = closed + 1 if closed >= 0 else length
            else:
                at = skip = length
            if skip == length:
                break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in P_CLOSED_BY and places["p"]:
            if places["p"][-1] >= max((places[b][-1] for b in P_SCOPE if places[b]), default=0):
                close(places["p"][-1])
        if tag in SELF_CLOSING:
            closes, scope = SELF_CLOSING[tag]
            barrier = max((places[b][-1] for b in scope if places[b]), default=0)
            inside = [i for c in closes for i in places[c][bisect.bisect_right(places[c], barrier) :][:1]]
            if inside:
                close(min(inside))
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        open_(tag, _attributes(rest))
    if at < length:
        text(page[at:])
    flush()
    for node in reversed(nodes):  # parents stand before their children
        if node.parent is not None:
            node.parent.held += node.held
    said = root.held - sum(n.held for n in remarks)
    best = max((n.held for n in mains if n.tag == "article"), default=0)
    main = any(n.held for n in mains)
    for node in mains:
        if node.tag == "main" or (node.held == best and 3 * best >= said):
            at_ = node.parent
            while at_ is not None and not at_.mains:
                at_.mains = True
                at_ = at_.parent
    gone: dict[int, bool] = {}

    def left_out(node: Node | None) -> bool:
        chain = []
        while node is not None and id(node) not in gone:
            chain.append(node)
            node = node.parent
        state = gone[id(node)] if node is not None else False
        for n in reversed(chain):
            stays = n.mains or (not main and not n.comment and 2 * n.held > said)
            state = state or (n.soft and not stays)
            gone[id(n)] = state
        return state

    kept = []
    for node, block, clean in blocks:
        if not left_out(node):
            kept.append((node, block))
            node.size += clean
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
    return kept, [c for c in containers if not left_out(c)] or [root]


def scores(page: str) -> list[tuple[str, float]]:
    """(path, score) of the containers: weighted clean text, added over containers of one path; deeper ones win ties."""
    total: dict[str, float] = {}
    for node in parse(page)[1]:
        total[node.path] = total.get(node.path, 0.0) + node.weight * node.size * (1 + 1e-6 * node.path.count("/"))
    return [(p, s) for p, s in total.items() if s > 0]


def extract(page: str, path: str | None) -> str:
    """Text of the containers at ``path``; of the page's own best ones where there are none or they are empty."""
    blocks, containers = parse(page)

    def under(target: str) -> list[str]:
        chosen = {id(n) for n in containers if n.path == target}
        held: dict[int, bool] = {}
        out = []
        for node, text in blocks:
            chain, at = [], node
            while at is not None and id(at) not in held and id(at) not in chosen:
                chain.append(id(at))
                at = at.parent
            state = at is not None and (id(at) in chosen or held[id(at)])
            held.update(dict.fromkeys(chain, state))
            if state:
                out.append(text)
        return out

    found = under(path) if path else []
    if not found:
        total: dict[str, float] = {}
        for node in containers:
            total[node.path] = total.get(node.path, 0.0) + node.weight * node.size * (1 + 1e-6 * node.path.count("/"))
        best = max(total, key=lambda p: (total[p], p)) if total else None
        found = under(best) if best is not None and total[best] > 0 else [t for _, t in blocks]
    return "\n".join(found)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path; votes are shares of a page's best score, ties go to the later name."""
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())]))

    def vote(texts: pd.Series) -> pd.Series:
        out = []
        for page in texts:
            found = scores(page)
            top = max((s for _, s in found), default=0.0)
            out.append([{"path": p, "share": s / top} for p, s in found if s >= VOTE_SHARE * top])
        return pd.Series(out, dtype=object)

    voted = pages.select(host_of().alias("host"), F.explode(F.pandas_udf(vote, kind)(F.coalesce("html", F.lit("")))).alias("v"))
    counted = voted.groupBy("host", "v.path").agg(F.sum("v.share").alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct(F.round("votes", 6), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    Ties of containers go to the deeper path, then to the later name; pages of any length are read whole.
    Null and empty pages give an empty text; a null or odd url belongs to the host "" and votes there; repeated
    rows are extracted alike and vote each time; extra columns are ignored; an empty table gives an empty result.
    """
    winners = cut(host_paths(pages))
    if fits_broadcast(winners, MAX_BROADCAST_HOSTS):
        winners = F.broadcast(winners)

    def cut_out(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([extract(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host")).join(winners, "host", "left")
    done = rows.select("page_id", "url", F.pandas_udf(cut_out, T.StringType())("html", "path").alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``main_text`` of all pages; its docstring defines every case."""
    return main_text(read(spark, sf_dir, "pages"))
