"""Main text of web pages by wrapper induction.

1. For each host, up to `pages_per_host` different pages, those with the smallest hashes, are merged into one template: each page's
   tree is aligned with it by simple tree matching (the best order-keeping match of children with equal names, then the same
   within the pairs), and nodes of a kind that it lacks are added. Hosts with fewer than three different pages share one template.
2. Every page is aligned with its template. A node that falls on a template node is in that slot; a node of a kind that the
   template lacks there is in an optional slot of its parent. Spark counts for each slot, over all different pages of the host,
   how often it holds the same text, how much text and how much of it is in links. Pages with the same longest block
   count once, so that one article under changing menus does not look constant.
3. The wrapper labels the slots. Constant slots are template: at least three different pages and half of those with the slot have one
   text there. Slots with little but links, without headings or paragraphs, are menus, even if their texts vary. Slots of elements for menus, headers, footers, sidebars,
   notices, adverts, forms and comments, by element, role or name, are labelled so too if half of the pages with the slot say so, and so are slots of main
   content (article, main). A name counts as a whole word, and never for what holds main content or, but for comments, most of a page's text.
   All other varying slots are content. What lies in main content is not judged by constancy or links.
4. A page's text is that of its blocks outside labelled slots; only that in main content if it has some. A page with nothing but menus keeps
   them. Nothing but the wrapper removes text.

The choice of pages in step 1 bounds the template tree only; all pages are counted and extracted, whole.

Defined cases: null and empty pages give an empty text. Pages without a host go with the small hosts. Repeated rows are extracted each
and count once. Ties between alignments go to the first. Broken markup never fails and takes time in proportion to its
length: unclosed elements end with their parent, an unfinished tag ends the page. Very long or deep pages are read whole. An empty table gives
no rows; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)|!--|[!?/])")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in "script style noscript template svg iframe textarea select title".split()}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "button", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLING_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"form"})}
NOISE_TAGS = frozenset("nav footer aside form head menu button dialog".split())
#: A class or id names noise if it is one of the first words, alone or with others of both lists: "site-header", but not "with-sidebar".
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACE_WORDS = frozenset("a bar block bottom box buttons container global icons inner item items left links list main message outer overlay page panel primary right secondary section site sub text the top wrap wrapper".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: What a node says of its slot, as bits.
NAMED, MAIN, WITHIN_MAIN, HOLDER = 1, 2, 4, 8
BITS = {"named": NAMED, "mains": MAIN, "within_main": WITHIN_MAIN, "holders": HOLDER}
#: How much text outside links a paragraph has that is no link of a menu.
PROSE = 20
#: Elements that may be menus when they hold links alone.
HOLDERS = frozenset("div dl nav ol section table ul menu center".split())


class Node:
    __slots__ = ("attrs", "kids", "kind", "links", "name", "parts", "text_hash")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs = name, attrs
        self.parts: list = []  # strings and nodes in page order
        self.kids: list[Node] = []
        self.links = 0  # characters of own text inside links, without blanks
        self.kind = name
        self.text_hash = 0


def parse(page: str) -> Node:
    """The tree of block elements; inline elements leave only their text."""
    root = Node("html")
    stack, at, in_link = [root], 0, False
    places: dict[str, list[int]] = {}  # of the open elements, by name

    def put(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            stack[-1].parts.append(text)
            if in_link:
                stack[-1].links += sum(map(len, text.split()))

    def close(to: int) -> None:
        while len(stack) > max(1, to):
            places[stack.pop().name].pop()

    def highest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def add(name: str, attrs: str, opens: bool) -> None:
        node = Node(name, attrs)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if opens:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)

    while True:
        m = MARK.search(page, at)
        put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:  # comments, declarations
            end = page.find("-->", m.start() + 2) if m[0] == "<!--" else page.find(">", at)
            if end < 0:
                break
            at = end + (3 if m[0] == "<!--" else 1)
            continue
        if not m[4]:  # a quote that is never closed: the tag ends at the next ">"
            at = page.find(">", at) + 1
            if not at:
                break
        name = name.lower()
        if name in RAW:
            if not m[1]:
                end = RAW[name].search(page, at)
                if not end:
                    break
                at = end.end()
        elif name == "a":
            in_link = not m[1]
        elif name == "br":
            stack[-1].parts.append(" ")
        elif name not in BLOCKS:
            if name == "hr":
                stack[-1].parts.append("\n")
        elif m[1]:
            in_link = False
            if places.get(name):
                close(places[name][-1])
        elif name in ("html", "body", "head"):
            if name == "body":
                close(1)
            if name != "html":
                add(name, m[3], True)
        else:
            in_link = False
            if stack[-1].name == "head":
                close(1)
            if name in CLOSES_P and stack[-1].name == "p":
                close(len(stack) - 1)
            if name in SIBLING_ENDS:
                ends, stops = SIBLING_ENDS[name]
                last = highest(stops)
                while (found := highest(ends)) > last:
                    close(found)
            add(name, m[3], not m[3].endswith("/") and name not in VOID)
    sign(root)
    return root


def own_text(node: Node) -> str:
    return " ".join(" ".join(p for p in node.parts if isinstance(p, str)).split())


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids)
    return out


def sign(root: Node) -> None:
    """Gives each node its kind, and the hash of its own text and of its children's."""
    for node in reversed(preorder(root)):
        if node.attrs:
            names = [v for name, *values in ATTRIBUTE.findall(node.attrs) if name.lower() in ("class", "id", "role") for v in values if v]
            node.kind = " ".join([node.name, *re.sub(r"\d+", "0", " ".join(names)).split()])
        node.text_hash = xxhash.xxh3_64_intdigest("\0".join([own_text(node), *(str(k.text_hash) for k in node.kids)]).encode("utf-8", "surrogatepass")) >> 1


class Slot:
    """A node of a template."""

    __slots__ = ("kids", "kind", "name", "number", "text_hash", "under")

    def __init__(self, kind: str, text_hash: int = 0):
        self.kind, self.name, self.text_hash = kind, kind.split(" ", 1)[0], text_hash
        self.kids: list[Slot] = []
        self.under: set[str] = set()  # kinds of its children
        self.number = 0

    def adopt(self, kid: Slot, at: int) -> None:
        self.kids.insert(at, kid)
        self.under.add(kid.kind)


def likeness(a, b, under: set[str]) -> int:
    """How well two nodes fit, 0 if not at all: equal kinds before equal names, then equal texts and kinds of children."""
    if a.name != b.name:
        return 0
    return 2 + 4 * (a.kind == b.kind) + 3 * (a.text_hash == b.text_hash) + min(3, sum(k.kind in under for k in b.kids))


class Likeness:
    """likeness() of all nodes of one list with all of another, a row at a time."""

    def __init__(self, a: list, b: list):
        number: dict[str, int] = {}
        code = lambda xs: np.array([number.setdefault(x, len(number)) for x in xs], np.int64)
        self.names = code([x.name for x in a]), code([x.name for x in b])
        self.kinds = code([x.kind for x in a]), code([x.kind for x in b])
        self.texts = tuple(np.array([x.text_hash for x in xs], np.int64) for xs in (a, b))
        # The children of b by their kinds, each kind with the places of its parents.
        owners: dict[str, list[int]] = {}
        for j, x in enumerate(b):
            for k in x.kids:
                owners.setdefault(k.kind, []).append(j)
        self.owners = {k: np.array(v) for k, v in owners.items()}
        self.under, self.n = [x.under for x in a], len(b)

    def row(self, i: int) -> np.ndarray:
        same = lambda pair: pair[0][i] == pair[1]
        kids = np.zeros(self.n, np.int64)
        for kind in self.under[i] & self.owners.keys():
            kids += np.bincount(self.owners[kind], minlength=self.n)
        return np.where(same(self.names), 2 + 4 * same(self.kinds) + 3 * same(self.texts) + np.minimum(3, kids), 0)


def scores(like: Likeness, rows: range, columns: slice, turned: bool = False) -> Iterator[np.ndarray]:
    """The rows of the table of best matches of beginnings; of ends if turned round."""
    width = len(range(*columns.indices(like.n)))
    now = np.zeros(width + 1, np.int64)
    yield now
    for i in reversed(rows) if turned else rows:
        w = like.row(i)[columns]
        w = w[::-1] if turned else w
        now = np.concatenate(([0], np.maximum.accumulate(np.maximum(now[1:], now[:-1] + w))))
        yield now


def matched(a: list, b: list, cells: int = 4_000_000) -> list[tuple[int, int]]:
    """The best order-keeping match of two lists of children.

    Equal nodes at both beginnings and both ends are pairs of a best match. The rest takes time in proportion to the product of its lengths. Tables of
    more than `cells` are halved where the best matches of both halves meet, so that memory is bounded; the match is as good.
    """
    low, m, n = 0, len(a), len(b)
    if m == 1 and n == 1:
        return [(0, 0)] if a[0].name == b[0].name else []
    same = lambda x, y: x.text_hash == y.text_hash and x.kind == y.kind
    while low < min(m, n) and same(a[low], b[low]):
        low += 1
    ends = 0
    while ends < min(m, n) - low and same(a[m - 1 - ends], b[n - 1 - ends]):
        ends += 1
    if low or ends:
        inner = [(i + low, j + low) for i, j in matched(a[low : m - ends], b[low : n - ends], cells)] if low + ends < min(m, n) else []
        return [(i, i) for i in range(low)] + inner + [(m - k, n - k) for k in range(ends, 0, -1)]
    if m * n > 64:
        like, out = Likeness(a, b), []
        todo = [(0, m, 0, n)]
        while todo:
            i, k, j, h = todo.pop()
            if (k - i) * (h - j) <= cells or k - i < 2:
                out += [(i + x, j + y) for x, y in traced(list(scores(like, range(i, k), slice(j, h))))] if k > i and h > j else []
                continue
            half = (i + k) // 2
            upper, lower = (list_end(scores(like, r, slice(j, h), t)) for r, t in ((range(i, half), False), (range(half, k), True)))
            cut = j + int(np.argmax(upper + lower[::-1]))
            todo += [(half, k, cut, h), (i, half, j, cut)]
        return out
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            w = likeness(x, y, x.under) if x.name == y.name else 0
            row[j + 1] = max(row[j], above[j + 1], above[j] + w)
    return traced(best)


def list_end(rows: Iterator[np.ndarray]) -> np.ndarray:
    for last in rows:
        pass
    return last


def traced(best: list) -> list[tuple[int, int]]:
    """The pairs behind the table of best matches."""
    out, i, j = [], len(best) - 1, len(best[0]) - 1
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class Template:
    """The merged tree of a host's pages."""

    def __init__(self) -> None:
        self.root = Slot("html")

    def merge(self, page: Node) -> None:
        todo = [(self.root, page)]
        while todo:
            slot, node = todo.pop()
            pairs = matched(slot.kids, node.kids)
            old = list(slot.kids)
            todo += [(old[i], node.kids[j]) for i, j in pairs]
            at, after = dict((j, i) for i, j in pairs), 0
            for j, kid in enumerate(node.kids):
                if j in at:
                    after = slot.kids.index(old[at[j]], after) + 1
                elif kid.kind not in slot.under or not old:
                    slot.adopt(Slot(kid.kind, kid.text_hash), after)
                    todo.append((slot.kids[after], kid))
                    after += 1

    def flat(self) -> tuple[list[str], list[int], list[int]]:
        """Kinds, text hashes and parents' numbers of all nodes in preorder."""
        kinds, hashes, parents, stack = [], [], [], [(self.root, -1)]
        while stack:
            slot, parent = stack.pop()
            stack += [(k, len(kinds)) for k in reversed(slot.kids)]
            kinds.append(slot.kind)
            hashes.append(slot.text_hash)
            parents.append(parent)
        return kinds, hashes, parents

    @classmethod
    def of(cls, kinds: list[str], hashes: list[int], parents: list[int]) -> Template:
        out, slots = cls(), []
        for number, (kind, text_hash, parent) in enumerate(zip(kinds, hashes, parents, strict=True)):
            slots.append(Slot(kind, text_hash) if number else out.root)
            slots[-1].number = number
            if number:
                slots[parent].adopt(slots[-1], len(slots[parent].kids))
        return out

    def slots_of(self, page: Node) -> dict[int, int]:
        """The slot of each node, by the node's id(): a template node's number, or a hash for an optional slot."""
        found = {id(page): 0}
        todo: list[tuple[Slot | None, Node]] = [(self.root, page)]
        while todo:
            slot, node = todo.pop()
            own = found[id(node)]
            at = {j: slot.kids[i] for i, j in matched(slot.kids, node.kids)} if slot and slot.kids and node.kids else {}
            for j, kid in enumerate(node.kids):
                fits = at.get(j)
                found[id(kid)] = fits.number if fits else -1 - (xxhash.xxh3_64_intdigest(f"{own} {kid.kind}".encode("utf-8", "surrogatepass")) >> 1)
                todo.append((fits, kid))
        return found


def named(value: str) -> set[str]:
    """The noise words of the classes or ids that name noise."""
    out: set[str] = set()
    for token in value.lower().split():
        words = [w for w in re.split(r"[_-]+|\d+", token) if w]
        if words and all(w in NOISE_WORDS or w in PLACE_WORDS for w in words):
            out.update(w for w in words if w in NOISE_WORDS)
    return out


def noise_of(node: Node) -> str:
    """Why a node is noise: "always", "comments", "header", "named", or "" if it is none.

    A header is noise unless it is the title of main content, and what has a name for noise unless it holds most of a page's text.
    """
    if node.name in NOISE_TAGS:
        return "always"
    if node.name == "header":
        return "header"
    if not node.attrs or node.name in ("html", "body"):
        return ""
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in NOISE_ROLES):
            return "always"
        if name == "style" and HIDDEN.search(value):
            return "always"
        if name in ("class", "id"):
            words |= named(value)
    comments = words & {"comment", "comments", "disqus", "replies", "respond"}
    if node.name in ("article", "main"):
        return "comments" if comments else ""
    return "comments" if comments else "header" if words == {"header"} else "named" if words else ""


def is_main(node: Node) -> bool:
    return node.name in ("article", "main") or (bool(node.attrs) and re.search(r"(?<!\S)role\s*=\s*[\"']?main\b", node.attrs, re.I) is not None)


def judged(bits):
    """Of nodes in main content only names and main content itself count."""
    return not bits & WITHIN_MAIN or bool(bits & (NAMED | MAIN))


def read_page(page: str, template: Template) -> tuple:
    """What is known of a page: lists over its nodes in preorder, lists over its blocks, and its identity.

    (slots, text hashes, characters outside links, characters in links, bits, last nodes below; nodes of blocks, blocks; hash of the longest block)
    """
    root = parse(page)
    nodes = preorder(root)
    number = {id(n): i for i, n in enumerate(nodes)}
    size = len(nodes)
    chars, links, last = [0] * size, [0] * size, list(range(size))
    heading, prose, holds_main = [False] * size, [False] * size, [False] * size
    bits, why = [0] * size, [noise_of(n) for n in nodes]
    for i, node in enumerate(nodes):
        if is_main(node):
            bits[i] |= MAIN | WITHIN_MAIN
        for k in node.kids:
            bits[number[id(k)]] = bits[i] & WITHIN_MAIN
    for i in range(size - 1, -1, -1):
        node = nodes[i]
        own = sum(len(p.replace(" ", "")) for p in node.parts if isinstance(p, str))
        links[i] += node.links
        chars[i] += max(0, own - node.links)
        heading[i] |= node.name in ("h1", "h2")
        for k in node.kids:
            at = number[id(k)]
            chars[i], links[i] = chars[i] + chars[at], links[i] + links[at]
            heading[i], prose[i], holds_main[i] = heading[i] | heading[at], prose[i] | prose[at], holds_main[i] | holds_main[at] | bool(bits[at] & MAIN)
        prose[i] |= node.name == "p" and chars[i] >= max(PROSE, links[i])
        if node.kids:
            last[i] = last[number[id(node.kids[-1])]]
    most = (chars[0] + links[0]) / 2
    for i, node in enumerate(nodes):
        title = why[i] == "header" and bool(bits[i] & WITHIN_MAIN) and heading[i]
        guarded = (why[i] in ("named", "header") or node.name == "form") and (holds_main[i] or chars[i] + links[i] > most)
        if why[i] and not title and not guarded:
            bits[i] |= NAMED
        if node.name in HOLDERS and not heading[i] and not prose[i]:
            bits[i] |= HOLDER
    block_nodes, blocks, run = [], [], []
    longest: tuple[int, str] = (0, "")
    stack: list = [root]
    open_: list[int] = []

    def flush() -> None:
        nonlocal longest
        text = " ".join("".join(run).split())
        if text:
            block_nodes.append(open_[-1])
            blocks.append(text)
            longest = max(longest, (len(text), text))
        run.clear()

    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
            continue
        if open_:
            flush()
        if part is None:
            open_.pop()
        else:
            open_.append(number[id(part)])
            stack.append(None)
            stack += reversed(part.parts)
    slots = template.slots_of(root)
    # Only what label_slots() may judge is told of a node.
    told = [judged(b) for b in bits]
    hashes, chars, links = ([x if t else 0 for x, t in zip(xs, told, strict=True)] for xs in ([n.text_hash for n in nodes], chars, links))
    return [slots[id(n)] for n in nodes], hashes, chars, links, bits, last, block_nodes, blocks, xxhash.xxh3_64_intdigest(longest[1].encode("utf-8", "surrogatepass")) >> 1


def chosen_text(slots: list[int], last: list[int], block_nodes: list[int], blocks: list[str], noise: set[int], mains: set[int], menus: set[int] = frozenset()) -> str:
    """The blocks outside noise slots and menus, and only those in main content if there are any. Menus stay in a page that has nothing else."""

    def below(chosen: set[int]) -> np.ndarray:
        depth = np.zeros(len(slots) + 1, np.int64)
        for i, slot in enumerate(slots):
            if slot in chosen:
                depth[i] += 1
                depth[last[i] + 1] -= 1
        return np.cumsum(depth)[np.array(block_nodes, np.int64)] > 0

    if not blocks:
        return ""
    kept = ~below(noise)
    other = kept & ~below(menus)
    kept = other if other.any() else kept
    main = kept & below(mains)
    return "\n\n".join(b for b, k in zip(blocks, main if main.any() else kept, strict=True) if k)


TEMPLATE = "kinds array<string>, hashes array<long>, parents array<int>"


def template_row(pages: list[str]) -> tuple[list[str], list[int], list[int]]:
    out = Template()
    for page in pages:
        out.merge(parse(page))
    return out.flat()


def induce_templates(pages: DataFrame, pages_per_host: int, least_pages: int) -> tuple[DataFrame, Template]:
    """(host, template) for each host with enough pages, and the template of the others; pages: (host, html)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's pages with the smallest hashes of their texts, for each host."""
        best: dict[str, dict[int, str]] = {}
        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                own = best.setdefault(host, {})
                own[xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1] = page
                if len(own) > pages_per_host:
                    del own[max(own)]
        rows = [(h, k, p) for h, own in best.items() for k, p in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "h", "html"])

    few = pages.mapInArrow(choose, "host string, h long, html string").dropDuplicates(["host", "h"])
    few = few.withColumn("i", F.row_number().over(W.partitionBy("host").orderBy("h"))).where(F.col("i") <= pages_per_host)
    few = written(few.withColumn("n", F.when(F.col("host") == "", 0).otherwise(F.count(F.lit(1)).over(W.partitionBy("host")))), "wrapper-pages")

    def learn(group: pa.Table) -> pa.Table:
        kinds, hashes, parents = template_row(group.sort_by("h")["html"].to_pylist())
        return pa.table({"host": group["host"][:1], "kinds": pa.array([kinds], pa.list_(pa.string())), "hashes": pa.array([hashes], pa.list_(pa.int64())), "parents": pa.array([parents], pa.list_(pa.int32()))})

    templates = few.where(F.col("n") >= least_pages).select("host", "h", "html").groupBy("host").applyInArrow(learn, f"host string, {TEMPLATE}")
    rest = few.where(F.col("n") < least_pages).orderBy("h").limit(pages_per_host).select("html").collect()
    return written(templates, "templates"), Template.of(*template_row([r["html"] for r in rest]))


def read_pages(pages: DataFrame, templates: DataFrame, shared: Template) -> DataFrame:
    """A row for each page with what read_page() gives, and the group of pages that its wrapper is for."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = {"slots": longs, "hashes": longs, "chars": ints, "links": ints, "bits": ints, "last": ints, "block_nodes": ints, "blocks": pa.list_(pa.string()), "identity": pa.int64()}
    names = {longs: "array<long>", ints: "array<int>", pa.list_(pa.string()): "array<string>", pa.int64(): "long"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Template] = (None, shared)
        for batch in batches:
            found, groups = [], []
            own = batch["kinds"].is_valid().to_pylist()
            for i, (host, page) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                if not own[i]:
                    host = ""
                elif host != last[0]:
                    last = (host, Template.of(*(batch[k][i].as_py() for k in ("kinds", "hashes", "parents"))))
                groups.append(host)
                found.append(read_page(page, last[1] if own[i] else shared))
            cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(groups, pa.string()), *cols], ["page_id", "url", "wrapper", *kinds])

    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, wrapper string, " + ", ".join(f"{k} {names[t]}" for k, t in kinds.items())
    return pages.join(templates, "host", "left").select("page_id", "url", "host", "html", *("kinds", "hashes", "parents")).mapInArrow(rows, schema)


def label_slots(pages: DataFrame, least_pages: int = 3, constant_share: float = 0.5, link_share: float = 0.6, name_share: float = 0.5) -> DataFrame:
    """(wrapper, noise, menus, mains): the labelled slots of each wrapper, from all different pages.

    What a node says of its slot by its name counts if at least `name_share` of the pages with the slot say so.
    """
    zipped = F.explode(F.arrays_zip("slots", "hashes", "chars", "links", "bits")).alias("z")
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) > 0
    seen = pages.select("wrapper", "identity", zipped).select("wrapper", "identity", "z.*").where(~has(WITHIN_MAIN) | has(NAMED | MAIN))
    key = ["wrapper", "slots"]
    # An optional slot may occur several times in a page: it is one observation then.
    seen = seen.groupBy(*key, "identity").agg(F.max("hashes").alias("hash"), F.max("chars").alias("chars"), F.max("links").alias("links"), F.bit_or("bits").alias("bits"))
    counts = [F.sum(has(bit).cast("long")).alias(name) for name, bit in BITS.items()]
    texts = seen.groupBy(*key, "hash").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in ("chars", "links")), *counts)
    slots = texts.groupBy(*key).agg(F.max("n").alias("top"), *(F.sum(k).alias(k) for k in ("n", "chars", "links", *BITS)))
    often = lambda name: F.col(name) >= F.col("n") * name_share
    size = F.col("chars") + F.col("links")
    constant = (F.col("top") >= least_pages) & (F.col("top") >= constant_share * F.col("n")) & (size > 0) & (F.col("slots") != 0)
    menu = often("holders") & (F.col("links") > link_share * size)
    outside = ~often("within_main")
    noise = often("named") | (outside & constant)
    menu = outside & menu & ~noise
    labelled = slots.select("wrapper", "slots", noise.alias("noise"), menu.alias("menu"), (often("mains") & ~noise & ~menu).alias("main")).where("noise or menu or main")
    return labelled.groupBy("wrapper").agg(*(F.collect_list(F.when(F.col(k), F.col("slots"))).alias(to) for k, to in (("noise", "noise"), ("menu", "menus"), ("main", "mains"))))


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", pages_per_host: int = 6, least_pages: int = 3) -> DataFrame:
    """(page_id, url, text) for each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))
    templates, shared = induce_templates(slim.where("html <> ''").select("host", "html"), pages_per_host, least_pages)
    read = written(read_pages(slim, templates, shared), "pages-read")
    wrappers = written(label_slots(read, least_pages), "wrappers")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set[int], set[int], set[int]] = (None, set(), set(), set())
        for batch in batches:
            texts = []
            lists = [batch[k].to_pylist() for k in ("wrapper", "slots", "last", "block_nodes", "blocks")]
            for i, (wrapper, *page) in enumerate(zip(*lists, strict=True)):
                if wrapper != last[0]:
                    last = (wrapper, *(set(batch[k][i].as_py() or ()) for k in ("noise", "mains", "menus")))
                texts.append(chosen_text(*page, *last[1:]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(slim.dtypes)["page_id"]
    joined = read.select("page_id", "url", "wrapper", "slots", "last", "block_nodes", "blocks").join(wrappers, "wrapper", "left")
    return joined.mapInArrow(rows, f"page_id {kind}, url string, text string")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
