"""Main text of web pages by wrappers inferred per host.

Each page becomes a stream of block tags and text slots. The streams of a host
are aligned one after the other: what repeats is folded into a group that may
repeat, what one side lacks becomes optional, and text becomes a slot. The
result is a union-free regular expression, the host's wrapper. Every page is
matched against it, which gives each block of text its slot; slots are judged
once a host, from where they stand and from whether their text changes between
pages, and every page of the host is read through them. A slot in a group that
repeats is judged by its turn, counted from the first and from the last.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

# HTML's void elements, raw text elements, and the elements that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
"""What an opening tag ends besides an open paragraph."""
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
KEEP_P = frozenset("option optgroup td th tr tbody thead tfoot caption body html head".split())
# What is furniture by its element, by a word of its class or id, or by its role.
ASIDE = frozenset("nav footer aside form header button select menu dialog search label fieldset head".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended breadcrumb breadcrumbs comment comments disqus respond replies reply nav navbar navigation menu header masthead topbar footer sidebar aside widget toolbar pagination pager copyright login search form skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_WORDS = frozenset("articlebody".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
ATTR = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
STATES = re.compile(r"(?:has|with|no|without)[-_]")
"""How a class begins that tells what its element has or lacks, not what it is."""
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment comments disqus respond replies reply".split())
"""Words of furniture whose articles are furniture too: comments, teasers and advertisements."""
# SOFT_MARK: furniture by its class or a form, which an enclosed main part ends; ASIDE_MARK: furniture with all it encloses; OTHERS_MARK: only <main> ends it
ASIDE_MARK, MAIN_MARK, SOFT_MARK, OTHERS_MARK = "-", "+", "~", "="
FURNITURE = (ASIDE_MARK, SOFT_MARK, OTHERS_MARK)
SHAPES = 64
"""About so many shapes or wrappers are aligned one after the other."""
COMMON = 0.8
"""A template's text is on this share of a host's different pages at least: nearly all."""


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if raw.strip(" /") else {}


def standing(tag: str, a: dict[str, str], inside: str) -> str:
    """`+` for the main part, `-`, `~` or `=` for furniture, else as what it stands in. Furniture holds for all it encloses, but a main part in furniture that only a class or a form tells is the main part."""
    if inside == ASIDE_MARK:
        return inside
    names = " ".join(x for x in f"{a.get('class', '')} {a.get('id', '')}".lower().split() if not STATES.match(x)) if a else ""
    words = set(re.split(r"[^a-z0-9]+", names))
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
    if hidden:
        return ASIDE_MARK
    if tag == "main" or role == "main":
        return ASIDE_MARK if words & {"comment", "comments", "related"} else MAIN_MARK
    if inside == OTHERS_MARK:
        return inside
    if tag == "article" or role == "article" or a.get("itemprop", "").lower() in MAIN_WORDS:
        return ASIDE_MARK if words & {"comment", "comments", "related"} else MAIN_MARK
    if tag in ("html", "body"):
        return inside
    if "form" not in (tag, role) and (tag in ASIDE or role in ROLES):
        return ASIDE_MARK
    if words & OTHERS:
        return OTHERS_MARK
    return SOFT_MARK if "form" in (tag, role) or words & WORDS else inside


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """(structure, labels, texts): the stream of block tags with `#n` for the nth text slot, and each slot's label and text.

    A label is the standing and the path of block tags above the slot. Texts
    have their character references decoded and their white space, line breaks
    of markup included, made single spaces.
    """
    stream: list[str] = []
    labels: list[str] = []
    texts: list[str] = []
    stack: list[tuple[str, str]] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                stream.append(f"#{len(labels)}")
                labels.append((stack[-1][1] if stack else "") + ">".join(t for t, _ in stack if t in BLOCK and t not in ("html", "body")))
                texts.append(text)

    def close_to(k: int) -> None:
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
            stream.extend(f"/{t}" for t, _ in reversed(stack[k:]) if t in BLOCK)
        del stack[k:]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                # an inline end tag does not end blocks, nor does any reach out of a cell
                if tag in BLOCK or not any(t in BLOCK for t, _ in stack[k:]):
                    if stack[k][1] != (stack[k - 1][1] if k else ""):
                        flush()
                    close_to(k)
                else:
                    del stack[k]
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else len(page))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            buffer.append(" ")
            continue
        if tag in BLOCK:
            if tag not in KEEP_P:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
                if k is not None:
                    close_to(k)
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SCOPE[tag]:
                        break
                    if stack[k][0] in CLOSES[tag]:
                        close_to(k)
                        break
            flush()
            stream.append(tag)
        a = attributes(m[3])
        inside = stack[-1][1] if stack else ""
        now = standing(tag, a, inside)
        if now != inside:
            flush()
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append((tag, now))
    close_to(0)
    flush()
    return stream, labels, texts


# -- wrappers: lists of nodes; a node is a tag, a slot "#label", or [quantifier, nodes] with "?" or "+" --

Node = str | list


def fold(nodes: list[Node], longest: int = 12) -> list[Node]:
    """Adjacent repeats of a run of nodes, shortest runs first, become one group that may repeat."""
    for size in range(1, longest + 1):
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            unit = nodes[k : k + size]
            n = 1
            while len(unit) == size and nodes[k + n * size : k + (n + 1) * size] == unit:
                n += 1
            if n > 1:
                group = unit[0] if size == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit]
                out.append(group)
                k += n * size
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def bare(n: Node) -> str:
    """A node without quantifiers: what it must equal to be aligned with another."""
    return n if isinstance(n, str) else "(" + " ".join(map(bare, n[1])) + ")" if len(n[1]) > 1 else bare(n[1][0])


def merged(a: Node, b: Node) -> Node:
    if isinstance(a, str) and isinstance(b, str):
        return a
    marks = {x[0] for x in (a, b) if isinstance(x, list)}
    if isinstance(a, list) and isinstance(b, list) and a[0] == b[0]:
        return [a[0], align(a[1], b[1])]
    inner = align(*[x[1] if isinstance(x, list) else [x] for x in (a, b)])
    return ["?" if marks == {"?"} else "+", inner] if marks != {"?", "+"} else ["?", [["+", inner]]]


def grouped(nodes: list[Node], like: list[Node]) -> list[Node]:
    """nodes with each run that `like` has as a group that may repeat made such a group."""
    for unit in [n[1] for n in like if isinstance(n, list) and n[0] == "+"]:
        out, k = [], 0
        while k < len(nodes):
            if nodes[k : k + len(unit)] == unit:
                out.append(["+", unit])
                k += len(unit)
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return fold(nodes)


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One expression for both: nodes they share in order stay, all others become optional."""
    a, b = grouped(a, b), grouped(b, a)
    if a == b:
        return a
    x, y = list(map(bare, a)), list(map(bare, b))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[Node] = []
    i = j = 0
    optional = lambda n: n if isinstance(n, list) and n[0] == "?" else ["?", [n]]
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold(out)


def slots(nodes: list[Node]) -> list[str]:
    """Labels of the wrapper's slots, each once, in order."""
    found: dict[str, None] = {}
    for n in nodes:
        if isinstance(n, list):
            found |= dict.fromkeys(slots(n[1]))
        elif n.startswith("#"):
            found[n[1:]] = None
    return list(found)


def shown(nodes: list[Node]) -> str:
    return " ".join(n if isinstance(n, str) else f"( {shown(n[1])} ){n[0]}" for n in nodes)


class Reader:
    """A wrapper as a program that reads streams: leaves, and splits with the preferred branch first."""

    def __init__(self, nodes: list[Node]):
        self.ops: list[str | tuple[int, int] | None] = []
        self.repeats: set[int] = set()
        self._compile(nodes, False)
        self.ops.append(None)  # the end
        self.known: dict[tuple[int, str | None], list[int]] = {}

    def _compile(self, nodes: list[Node], repeats: bool) -> None:
        for n in nodes:
            at = len(self.ops)
            if isinstance(n, str):
                self.ops.append(n)
                if repeats:
                    self.repeats.add(at)
            elif n[0] == "?":
                self.ops.append((0, 0))
                self._compile(n[1], repeats)
                self.ops[at] = (at + 1, len(self.ops))
            else:
                self._compile(n[1], True)
                self.ops.append((at, len(self.ops) + 1))

    def after(self, at: int, token: str | None) -> list[int]:
        """The leaves with that token, or the end for None, that can come next, the preferred first."""
        if (at, token) not in self.known:
            found, seen, todo = [], set(), [at]
            while todo:
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                if isinstance(self.ops[k], tuple):
                    todo.extend(reversed(self.ops[k]))
                elif self.ops[k] == token:
                    found.append(k)
            self.known[at, token] = found
        return self.known[at, token]

    def match(self, stream: list[str]) -> list[int] | None:
        """The leaf of each token, or None where the wrapper doesn't hold the stream. What failed once at a token isn't tried there again."""
        tokens = [*stream, None]
        path: list[int] = []
        dead: set[tuple[int, int]] = set()
        frames = [iter(self.after(0, tokens[0]))]
        while frames:
            k = next(frames[-1], None)
            if k is None:
                frames.pop()
                if path:
                    dead.add((len(path), path.pop()))
            elif len(path) == len(stream):
                return path
            elif (len(path) + 1, k) not in dead:
                path.append(k)
                frames.append(iter(self.after(k + 1, tokens[len(path)])))
        return None

    def places(self, stream: list[str]) -> list[list[int]]:
        """For each text of the stream the places it has in the wrapper: its slot and its turn there, and in a group that repeats the turn from the last too."""
        at = [k for k, t in zip(self.match(stream) or [], stream) if t[0] == "#"]
        if not at:
            return [[] for t in stream if t[0] == "#"]
        total, turn, out = Counter(at), Counter(), []
        for k in at:
            out.append([(k << 32) + turn[k], (k << 32) + turn[k] - total[k]] if k in self.repeats else [k << 32])
            turn[k] += 1
        return out


class Readers:
    """Wrappers compiled, those of the last few megabytes."""

    def __init__(self) -> None:
        self.held: dict[str, Reader] = {}
        self.size = 0

    def of(self, shape: str) -> Reader:
        if shape not in self.held:
            if self.size > 1 << 22:
                self.held, self.size = {}, 0
            self.held[shape] = Reader(json.loads(shape))
            self.size += len(shape)
        return self.held[shape]


def labelled(stream: str, labels: list[str]) -> list[str]:
    of = iter(labels)
    return ["#" + next(of) if t == "#" else t for t in stream.split()]


PARSED = "page_id {id}, url string, host string, shape string, stream string, labels array<string>, texts array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [blocks(x or "") for x in b.column("html").to_pylist()]
        shapes = [json.dumps(fold([f"#{labels[int(t[1:])]}" if t[0] == "#" else t for t in stream])) for stream, labels, _ in rows]
        hosts = [(re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1].lower() for u in b.column("url").to_pylist()]
        streams = [" ".join(t[0] if t[0] == "#" else t for t in stream) for stream, _, _ in rows]
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(hosts), pa.array(shapes), pa.array(streams), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind)],
            names=["page_id", "url", "host", "shape", "stream", "labels", "texts"],
        )


def _wrap(key: tuple, shapes: pa.Table) -> pa.Table:
    """One wrapper from the distinct expressions of a group, the commonest first."""
    rows = sorted(zip(shapes.column("n").to_pylist(), shapes.column("shape").to_pylist()), key=lambda r: (-r[0], r[1]))
    nodes: list[Node] = json.loads(rows[0][1])
    for _, s in rows[1:]:
        nodes = align(nodes, json.loads(s))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "n": pa.array([sum(r[0] for r in rows)], pa.int64()), "shape": pa.array([json.dumps(nodes)], pa.string())})


def wrappers(parsed: DataFrame, most: int = SHAPES) -> DataFrame:
    """One row per host: host, n pages, shape. Distinct shapes are counted first, aligned in groups of about `most`, and then the groups' wrappers with one another, until a host has one: no page is left out, no group gathers pages, and no task aligns more than a group at a time."""
    shapes, turn = staged(parsed.groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes"), 0
    while True:
        groups = shapes.groupBy("host").agg(F.ceil(F.count("*") / most).alias("groups"))
        again = groups.agg(F.max("groups")).first()[0] or 1
        dealt = shapes.join(groups, "host").withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "shape"), "groups"))
        shapes, turn = staged(dealt.groupBy("host", "group").applyInArrow(_wrap, "host string, n bigint, shape string"), "shapes"), turn + 1
        if again == 1:
            return shapes


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place of each text that is neither furniture nor of the main part."""
    readers = Readers()
    for b in batches:
        rows: list[tuple[str, int, int, int]] = []
        for host, page, wrapper, stream, labels, hashes in zip(*[b.column(c).to_pylist() for c in ("host", "page", "wrapper", "stream", "labels", "hashes")]):
            if all(x[:1] in (MAIN_MARK, *FURNITURE) for x in labels):
                continue
            places = readers.of(wrapper).places(labelled(stream, labels))
            rows += [(host, page, p, t) for x, t, ps in zip(labels, hashes, places) if x[:1] not in (MAIN_MARK, *FURNITURE) for p in ps]
        names = ["host", "page", "place", "t"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(4)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers = Readers()
    for b in batches:
        out = []
        for wrapper, fixed, stream, labels, texts in zip(*[b.column(c).to_pylist() for c in ("wrapper", "fixed", "stream", "labels", "texts")]):
            main = [t for x, t in zip(labels, texts) if x[:1] == MAIN_MARK]
            if not main and labels:
                template = set(fixed or ())
                places = readers.of(wrapper).places(labelled(stream, labels)) if template else [[]] * len(labels)
                main = [t for x, t, ps in zip(labels, texts, places) if x[:1] not in FURNITURE and template.isdisjoint(ps)]
            out.append("\n".join(main))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    A page's main slots are its text; without any, its slots that are no
    furniture, less those whose text is the same on every page that has them,
    where at least three different pages and nearly all of the host's (COMMON)
    have. A null or empty page has the empty text; a null url, or one without
    a host, belongs to the host ''. Repeated rows and identifiers give repeated
    rows.
    """
    ident = pages.schema[id_col].dataType.simpleString()
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = staged(df.mapInArrow(_parse, PARSED.format(id=ident)), "pages")
    wrapper = wrappers(parsed.select("host", "shape")).select("host", F.col("shape").alias("wrapper"))
    # a slot with one text on nearly all pages, on a host whose pages differ, is part of the template
    hashed = parsed.select("host", F.xxhash64(F.array_join("texts", "\n")).alias("page"), "stream", "labels", F.transform("texts", lambda t: F.xxhash64(t)).alias("hashes"))
    one = hashed.join(wrapper, "host").mapInArrow(_seen, "host string, page bigint, place bigint, t bigint")
    one = one.groupBy("host", "place", "page").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    same = one.groupBy("host", "place").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count("*").alias("pages")).where("a = z AND pages >= 3")
    whole = parsed.where(F.size("texts") > 0).select("host", F.xxhash64(F.array_join("texts", "\n")).alias("page")).distinct().groupBy("host").agg(F.count("*").alias("of"))
    fixed = same.join(whole, "host").where(F.col("pages") >= COMMON * F.col("of")).groupBy("host").agg(F.collect_list("place").alias("fixed"))
    judged = staged(wrapper.join(fixed, "host", "left"), "judged")
    read = parsed.select("page_id", "url", "host", "stream", "labels", "texts").join(judged, "host")
    read = read.mapInArrow(_read, f"page_id {ident}, url string, text string")
    return read.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
