"""Main text of web pages: site templates by their recurrence go first, then boilerplate by its markup.

1. Every page is parsed into a tree (unclosed and misnested tags are closed as browsers
   do), and each block element is hashed with all below it. The hashes are counted per host
   in Spark, once for each different article text, so copies of one article are no
   template: a subtree that stands on `min_pages` or more different articles is one.
   Menus whose words vary are hashed by their shell, the structure without the text, if
   they are mostly links; a shell is a template if it also holds a small share of its pages.
2. The templates of a page's host are deleted from its tree.
3. What remains is read by markup: the content is what the page's article elements hold,
   else its main element, else its body; from it go menus, headers, footers, sidebars,
   notices, adverts, forms, scripts, styles and comments, known by tag, role, or the
   names of class and id.

Never templates are article and main elements, those around them, the body, and text blocks
(headings, paragraphs, list items, quotes, tables, preformatted text) inside an article or
main element, so that repeated text of articles stays. Names of class and id are
compared whole, but for parts that only say where a thing stands (site-footer); they never
rule out an element that holds more than half of the content, or what is around an article.
An article so named, as a reader's comment is, goes only beside another one or if it holds
less than half of the page; one whose text is all links goes beside another one.

Blocks are joined by one newline; white space within a block is one space; a line break
element counts as white space. Character references are decoded after the tags are read.

Templates are sent to the workers as a sorted array while they are at most
`BROADCAST_TEMPLATES`; beyond that each page is joined with its own. The result is the same.

Defined cases: null or empty html has an empty text; a null url belongs to the empty
host; a tag cut off at the end of the html is dropped. Rows with the same id are told
apart by a hash of their html; repeated rows give repeated rows. Parsing takes time in
proportion to a page's length, however its tags are nested. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import shared
from tidemark.llm.url_filter import host_of

#: Different article texts of a host on which a subtree must stand to be a template.
MIN_PAGES = 5
#: Share of a page's text that a shell may hold on average, and share of links from which a subtree is a menu.
SHELL_SHARE, MENU = 0.2, 0.5
#: As many templates (8 bytes each) may be sent to the workers.
BROADCAST_TEMPLATES = 2_000_000

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
TEXT_BLOCKS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary table tbody td tfoot th thead tr".split())
BLOCKS = TEXT_BLOCKS | frozenset("address article aside body center dialog dir div dl details fieldset figure footer form header hgroup hr html main menu nav ol search section ul".split())
DROPPED = RAW | frozenset("aside audio button canvas dialog footer form head header input menu nav object option search select svg video".split())
#: Tags that rule out an article below them.
ASIDE = RAW | frozenset("aside audio button canvas dialog footer head menu nav object select svg video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset("ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Parts of a name that say where a marked thing stands, or that it holds several.
PLACES = frozenset("area bar block bottom box buttons container global item items left links list main mobile page panel primary right secondary section site thread top wrap wrapper".split())
#: An opening tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = ("td", "th", "table", "button", "caption", "html", "object", "template")
_CONTENT = ("article", "body", "main")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # of str and Node
    digest: int = 0
    shell: int = 0
    size: int = 0  # characters of its text that aren't white space
    linked: int = 0  # those of them that are in links
    holds: bool = False  # an article or main element is below it
    _found: dict | None = None

    def found(self) -> dict[str, str]:
        if self._found is None:
            self._found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(self.attributes)} if self.attributes and not self.attributes.isspace() else {}
        return self._found

    def hidden(self) -> bool:
        """Whether tag or role say that this is no content."""
        if self.tag in DROPPED:
            return True
        found = self.found()
        return bool(found) and ("hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")) is not None)

    def named(self) -> bool:
        """Whether a name of class or id says so."""
        for name in ("class", "id"):
            for word in self.found().get(name, "").lower().split():
                if word in MARKS:
                    return True
                parts = re.split(r"[-_]+", word)
                if any(p in MARKS for p in parts) and all(p in MARKS or p in PLACES for p in parts):
                    return True
        return False


def parse(html: str) -> Node:
    root = Node("#page")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag's elements are
    at, end = 0, len(html)

    def top(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(k: int) -> None:
        for n in stack[k:]:
            places[n.tag].pop()
        del stack[k:]

    def enter(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag or (m[4] or m[8]) != ">":
            continue
        if m[1] or m[5]:
            k = top(tag)
            if k and (tag in ("body", "html") or k >= top(*_CONTENT)):
                close(k)
            continue
        if tag in BLOCKS and places["p"]:  # closes an open paragraph
            k = places["p"][-1]
            if k > top(*_SCOPE):
                close(k)
        if tag in CLOSES and any(places.get(t) for t in CLOSES[tag][0]):
            gone, until = CLOSES[tag]
            edge = top(*until)
            cut = min((places[t][j] for t in gone if places.get(t) and (j := bisect_right(places[t], edge)) < len(places[t])), default=0)
            if cut:
                close(cut)
        node = Node(tag, m[3] or m[7] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = found.end() if found else end
        elif tag not in VOID and (not node.attributes.endswith("/") or tag in BLOCKS or tag in ("b", "i", "em", "strong", "span", "a")):
            enter(node)  # a slash on such a tag means nothing in HTML
    return root


def _walk(node: Node) -> Iterator[tuple[Node, bool]]:
    """(node, leaving) over the tree in page order, without recursion."""
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        n, leaving = todo.pop()
        yield n, leaving
        if not leaving:
            todo.append((n, True))
            todo += [(c, False) for c in reversed(n.children) if isinstance(c, Node)]


def _hash(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "replace"))


def measured(page: Node, hashed: bool = True) -> Node:
    """Counts each element's characters, and hashes it with all that is below it, with and without its text."""
    for n, leaving in _walk(page):
        if not leaving:
            continue
        exact, shell, size, linked = [n.tag], [n.tag], 0, 0
        if hashed and n.attributes:
            shell += [" ".join(sorted(n.found().get("class", "").split())), n.found().get("id", "")]
        for c in n.children:
            if isinstance(c, Node):
                if hashed:
                    exact.append(f"<{c.digest:x}>")
                    if shell[-1] != f"<{c.shell:x}>":  # as many like ones as there may be
                        shell.append(f"<{c.shell:x}>")
                n.holds |= c.holds or c.tag in ("article", "main")
                if c.tag not in RAW:
                    size += c.size
                    linked += c.linked
            else:
                words = c.split()
                if hashed:
                    exact.append(" ".join(words))
                size += sum(map(len, words))
        n.size, n.linked = size, size if n.tag == "a" else linked
        if hashed:
            n.digest, n.shell = _hash(exact), _hash(["shell", *shell])
    return page


def candidates(page: Node) -> dict[int, int]:
    """Hashes of the subtrees of a measured page that may be templates, and the characters that they hold on it. Shells have the last bit set."""
    out: dict[int, int] = defaultdict(int)
    inside = 0
    for n, leaving in _walk(page):
        content = n.tag in _CONTENT
        if n.tag in ("article", "main"):
            inside += -1 if leaving else 1
        if leaving or content or n.tag not in BLOCKS or n.tag == "html" or n.holds or not n.children:
            continue
        if not (inside and n.tag in TEXT_BLOCKS):
            out[n.digest & ~1] += n.size
        if not inside and n.size and n.linked >= MENU * n.size and n.tag not in TEXT_BLOCKS:
            out[n.shell | 1] += n.size
    return dict(out)


def without(page: Node, templates) -> int:
    """Replaces the subtrees of a measured page whose hash `templates` has by the end of a block; how many there were."""
    inside = gone = 0
    for n, leaving in _walk(page):
        if n.tag in ("article", "main"):
            inside += -1 if leaving else 1
        if leaving:
            continue
        for k, c in enumerate(n.children):
            if isinstance(c, Node) and c.tag in BLOCKS and c.tag not in _CONTENT and c.tag != "html" and not c.holds and c.children:
                exact = not (inside and c.tag in TEXT_BLOCKS) and c.digest & ~1 in templates
                if exact or (not inside and c.tag not in TEXT_BLOCKS and c.size and c.linked >= MENU * c.size and c.shell | 1 in templates):
                    n.children[k] = Node("hr")
                    gone += 1
    return gone


def contents(page: Node) -> list[Node]:
    """The outermost article elements, else main elements, else the body or the page."""
    for wanted in ("article", "main"):
        found, skip = [], None
        for n, leaving in _walk(page):
            if skip is not None:
                skip = None if leaving and n is skip else skip
            elif not leaving and (n.tag == wanted or wanted == "main" and n.found().get("role", "").lower() == "main"):
                found.append(n)
                skip = n
            elif not leaving and (n.tag in ASIDE or n.hidden() and n.tag not in ("form", "header")):
                skip = n
        for ruled_out in (Node.hidden, Node.named, lambda n: n.size > 0 and n.linked == n.size):
            kept = [n for n in found if not ruled_out(n)]
            found = kept or found
        if found and not (wanted == "article" and all(n.named() for n in found) and 2 * sum(n.size for n in found) < page.size):
            return found
    return next(([n] for n, _ in _walk(page) if n.tag == "body"), [page])


def blocks(content: Node) -> list[str]:
    """Texts of the content's blocks, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [content]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif n is not content and (n.hidden() or n.named() and (2 * n.size <= content.size or n.tag == "article")):
            if n.tag in BLOCKS:
                flush()
        else:
            if n.tag in BLOCKS:
                if n.tag in ("td", "th"):
                    line.append(" ")
                    todo += reversed([*n.children, " "])
                    continue
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


def main_text(page: Node) -> str:
    """The text of a measured page."""
    return "\n".join(t for c in contents(page) for t in blocks(c)).encode("utf-8", "replace").decode()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _own(host: str, subtree: int) -> int:
    """A subtree's hash on one host."""
    return xxhash.xxh3_64_intdigest(f"{host}\x00{subtree:x}".encode("utf-8", "replace"))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "of_html", "own", "shell", "article", "share"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float32()]
    for batch in batches:
        rows: list[tuple] = []
        for page_id, host, of_html, html in zip(*(batch.column(k).to_pylist() for k in range(4))):
            page = measured(parse(html or ""))
            article = _signed(xxhash.xxh3_64_intdigest(main_text(page).encode()))
            rows += [(page_id, of_html, _signed(_own(host, h)), bool(h & 1), article, size / max(1, page.size)) for h, size in candidates(page).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    shared.release()


def subtrees(pages: DataFrame) -> DataFrame:
    """page_id, of_html, own (hash of host and subtree), shell, article, share; of (page_id, host, of_html, html)."""
    return pages.select("page_id", "host", "of_html", "html").mapInArrow(_subtrees, "page_id long, of_html long, own long, shell boolean, article long, share float")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """own, of subtrees that stand on `min_pages` or more different articles of their host; shells hold little of them."""
    one = found.groupBy("own", "shell", "article").agg(F.max("share").alias("share"))
    counted = one.groupBy("own", "shell").agg(F.count("*").alias("n"), F.avg("share").alias("share"))
    return counted.filter((F.col("n") >= min_pages) & (~F.col("shell") | (F.col("share") <= SHELL_SHARE))).select("own")


class _Held:
    """The templates of one host, looked up in a sorted array of all hosts' ones."""

    def __init__(self, host: str, keys: np.ndarray):
        self.host, self.keys = host, keys

    def __contains__(self, subtree: int) -> bool:
        own = np.int64(_signed(_own(self.host, subtree)))
        at = int(np.searchsorted(self.keys, own))
        return at < len(self.keys) and self.keys[at] == own


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a page: page_id, url, text and n_chars."""
    spark = pages.sparkSession
    shared.bounded_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("of_html", F.xxhash64("html"))
    found, _ = shared.written(subtrees(rows), "subtrees")
    known, _ = shared.written(templates(found, min_pages), "templates")
    if known.count() <= BROADCAST_TEMPLATES:
        keys = spark.sparkContext.broadcast(np.sort(np.array([r["own"] for r in known.toLocalIterator()], np.int64)))
        joined = rows.withColumn("cut", F.lit(None).cast("array<bigint>"))
    else:
        keys = None
        here = found.select("page_id", "of_html", "own").distinct().join(known.hint("merge"), "own")
        cut = here.groupBy(F.col("page_id").alias("cut_id"), F.col("of_html").alias("cut_html")).agg(F.collect_set("own").alias("cut"))
        joined = rows.join(cut, F.col("page_id").eqNullSafe(F.col("cut_id")) & (F.col("of_html") == F.col("cut_html")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, source, own in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                held = _Held(host, keys.value if keys is not None else np.sort(np.array(own or (), np.int64)))
                page = measured(parse(source or ""), hashed=len(held.keys) > 0)
                if len(held.keys) and without(page, held):
                    measured(page, hashed=False)
                texts.append(main_text(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        shared.release()

    return joined.select("page_id", "url", "host", "html", "cut").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
