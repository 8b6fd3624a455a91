"""Page -> element rows. HTML is read once; every later operator is relational.

One Arrow batch of pages goes into a worker and one or more batches of element
rows come out, so a task holds a bounded number of pages at any time. Rows of a
page leave one task together, which keeps the map-side half of every later
``groupBy(page_id, ..)`` nearly complete.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from webframe.schemas import NODE_FIELDS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
HEAD_ONLY = frozenset("title meta link style script base template noscript".split())
UNSEEN = frozenset("head script style noscript template title meta link iframe textarea select".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody thead tfoot tr ul option".split()
)
# A start tag on the left ends the open elements on the right, unless a fence is met first.
_P_ENDERS = BLOCK - frozenset("body dd dt html li option tbody thead tfoot tr".split())
ENDS = {t: frozenset(["p"]) for t in _P_ENDERS}
ENDS.update(
    li=frozenset(["li", "p"]), dd=frozenset(["dd", "dt", "p"]), dt=frozenset(["dd", "dt", "p"]),
    option=frozenset(["option"]), optgroup=frozenset(["option", "optgroup"]),
    tr=frozenset("tr td th p li".split()), td=frozenset("td th p li".split()), th=frozenset("td th p li".split()),
    tbody=frozenset("tbody thead tfoot tr td th p".split()), tfoot=frozenset("tbody thead tr td th p".split()),
)
FENCE = frozenset("table ul ol dl select div section article main nav aside button body template".split())
TABLE_FENCE = frozenset("table template body".split())
ITEM_FENCE = frozenset("ul ol table template body menu".split())
_FENCES = {
    **{t: TABLE_FENCE for t in "tr td th tbody thead tfoot".split()},
    "li": ITEM_FENCE, "dd": frozenset("dl table body template".split()), "dt": frozenset("dl table body template".split()),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STRUCTURAL = re.compile(r"[/#.:!% \t\r\n\f]")


def escape_token(name: str) -> str:
    """Ids and classes inside ``path`` never contain its separators."""
    return _STRUCTURAL.sub(lambda m: "%%%02X" % ord(m.group()), name)


class _Tree:
    """Element rows of one page, as parallel lists."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.hidden: list[bool] = []
        # places in the source: of the start tag, behind it, of the end tag, behind it
        self.begin: list[int] = []
        self.inner: list[int] = []
        self.inner_end: list[int] = []
        self.close: list[int] = []
        self.pieces: list[str] = []
        self.seen_from: list[int] = []
        self.seen_to: list[int] = []
        self.all_text: list[str] = []
        self.all_from: list[int] = []
        self.all_to: list[int] = []
        self.own: list[list[str] | None] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        self.gap = True
        self.in_body = False

    def newline(self) -> None:
        p = self.pieces
        if p and p[-1] != "\n":
            if p[-1].endswith(" "):
                p[-1] = p[-1][:-1]
            p.append("\n")
        self.gap = True

    def text(self, raw: str) -> None:
        if not self.stack:
            if not raw.strip():
                return
            self.ensure_body()
        if "&" in raw:
            raw = html_lib.unescape(raw)
        top = self.stack[-1]
        if self.own[top] is None:
            self.own[top] = [raw]
        else:
            self.own[top].append(raw)
        self.all_text.append(raw)
        if not self.hidden[top]:
            t = _SPACE.sub(" ", raw)
            if self.gap and t.startswith(" "):
                t = t[1:]
            if t:
                self.pieces.append(t)
                self.gap = t[-1] == " "

    def ensure_body(self) -> None:
        if not self.stack and not self.tag:
            self.push("html", {}, 0, 0)
        if not self.in_body:
            while len(self.stack) > 1:
                self.pop(0, 0)
            self.push("body", {}, 0, 0)

    def push(self, tag: str, attrs: dict, start: int, inner: int) -> None:
        if tag == "body":
            self.in_body = True
        up = self.stack[-1] if self.stack else -1
        gone = (up >= 0 and self.hidden[up]) or tag in UNSEEN
        if attrs and not gone:
            gone = (
                "hidden" in attrs
                or (tag == "input" and attrs.get("type", "").lower() == "hidden")
                or ("style" in attrs and _INVISIBLE.search(attrs["style"]) is not None)
            )
        if tag in BLOCK or tag == "br":
            self.newline()
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(up)
        self.end.append(node)
        self.hidden.append(gone)
        self.begin.append(start)
        self.inner.append(inner)
        self.inner_end.append(inner)
        self.close.append(inner)
        self.seen_from.append(len(self.pieces))
        self.seen_to.append(0)
        self.all_from.append(len(self.all_text))
        self.all_to.append(0)
        self.own.append(None)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self, inner_end: int, end: int) -> None:
        node = self.stack.pop()
        tag = self.tag[node]
        self.open[tag] -= 1
        self.end[node] = len(self.tag) - 1
        self.inner_end[node] = inner_end
        self.close[node] = end
        self.seen_to[node] = len(self.pieces)
        self.all_to[node] = len(self.all_text)
        if tag in BLOCK:
            self.newline()

    def start(self, tag: str, attrs: dict, at: int, after: int) -> None:
        if self.in_body:
            if tag in ("html", "body", "head"):
                return
        elif tag == "html":
            if self.tag:
                return
        elif tag == "body":
            if not self.tag:
                self.push("html", {}, at, at)
            while len(self.stack) > 1:
                self.pop(at, at)
        elif tag == "head":
            if len(self.tag) > 1:
                return
            if not self.tag:
                self.push("html", {}, at, at)
        else:
            if not self.tag:
                self.push("html", {}, at, at)
            if tag not in HEAD_ONLY:
                self.ensure_body()
        ends = ENDS.get(tag)
        if ends and any([self.open.get(e) for e in ends]):
            fence = _FENCES.get(tag, FENCE)
            depth = len(self.stack)
            cut = depth
            for i in range(depth - 1, -1, -1):
                name = self.tag[self.stack[i]]
                if name in ends:
                    cut = i
                elif name in fence:
                    break
            while len(self.stack) > cut:
                self.pop(at, at)
        if tag == "tr" and self.stack and self.tag[self.stack[-1]] == "table":
            self.push("tbody", {}, at, at)
        self.push(tag, attrs, at, after)
        if tag in VOID:
            self.pop(after, after)

    def finish(self, tag: str, at: int, after: int) -> None:
        if tag in ("html", "body") or not self.open.get(tag):
            return
        if self.tag[self.stack[-1]] == tag:
            self.pop(at, after)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.tag[self.stack[i]]
            if name == tag:
                while len(self.stack) > i + 1:
                    self.pop(at, at)
                self.pop(at, after)
                return
            if name in ("table", "body", "template") and tag not in BLOCK:
                return


def _attributes(raw: str) -> dict:
    out: dict = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        name = name.lower()
        if name not in out:
            out[name] = html_lib.unescape(value) if "&" in value else value
    return out


def build_tree(source: str) -> _Tree:
    tree, pos, size = _Tree(), 0, len(source)
    last = source.rfind(">")  # no tag ends behind it, so nothing there is tried again and again
    while pos < size:
        at = source.find("<", pos)
        if at > last and not source.startswith("<!--", at):
            m = source.find("<!--", at)
            tree.text(source[pos:m] if m >= 0 else source[pos:])
            pos = m if m >= 0 else size
            continue
        m = at >= 0 and (_TOKEN.match(source, at) or _TOKEN.search(source, at + 1))
        if not m:
            tree.text(source[pos:])
            break
        at, after = m.span()
        if at > pos:
            tree.text(source[pos:at])
        pos = after
        ending, name, raw, ending_too, name_too, raw_too = m.groups()
        if not name:
            ending, name, raw = ending_too, name_too, raw_too
        if name is None:
            continue
        name = name.lower()
        if ending:
            tree.finish(name, at, after)
            continue
        tree.start(name, _attributes(raw) if raw and not raw.isspace() else {}, at, after)
        if name in RAW:
            close = re.compile("</" + name + r"(?=[\s/>])[^>]*>|\Z", re.I).search(source, after)
            if close.start() > after:
                tree.text(source[after:close.start()])
            tree.finish(name, close.start(), close.end())
            pos = close.end()
    while tree.stack:
        tree.pop(size, size)
    return tree


class _Batch:
    """Collects element rows and turns them into Arrow batches column by column."""

    def __init__(self, columns: Sequence[str], tags: frozenset | None, carry: Sequence[str], schema: pa.Schema) -> None:
        self.columns, self.tags, self.carry, self.schema = columns, tags, carry, schema
        self.want = frozenset(columns)
        self.known: dict[str, str] = {}
        self.clear()

    def class_tokens(self, classes: str) -> str:
        found = self.known.get(classes)
        if found is None:
            found = "".join(["." + escape_token(c) for c in classes.split()])
            if len(classes) < 200 and len(self.known) < 4096:
                self.known[classes] = found
        return found

    def clear(self) -> None:
        self.rows: dict[str, list] = {c: [] for c in ("page_id", *self.carry, *self.columns)}
        self.size = 0

    def add(self, page_id: int, carried: tuple, source: str, tree: _Tree) -> Iterator[pa.RecordBatch]:
        """Takes the rows of a page in; yields batches that are full."""
        want, rows = self.want, self.rows
        tags, parent, attrs = tree.tag, tree.parent, tree.attrs
        n = len(tags)
        sib, nth, kids, depth = [0] * n, [0] * n, [0] * n, [0] * n
        per_type: dict = {}
        for i in range(n):
            up = parent[i]
            if up >= 0:
                depth[i] = depth[up] + 1
                kids[up] += 1
                sib[i] = kids[up]
            key = (up, tags[i])
            nth[i] = per_type[key] = per_type.get(key, 0) + 1
        links = imgs = ()
        if "n_links" in want or "n_imgs" in want:
            links = [1 if tags[i] == "a" and "href" in attrs[i] else 0 for i in range(n)]
            imgs = [1 if tags[i] == "img" and "src" in attrs[i] else 0 for i in range(n)]
            for i in range(n - 1, 0, -1):
                links[parent[i]] += links[i]
                imgs[parent[i]] += imgs[i]
        keep = range(n) if self.tags is None else [i for i in range(n) if tags[i] in self.tags]
        # no row of the page counts more than this
        most = 200
        if "text" in want:
            most += sum(map(len, tree.all_text)) + len(tree.pieces)
        most += len(source) * (("inner_html" in want) + ("outer_html" in want))
        segments: list = []
        if "path" in want:
            for i in range(n):
                a = attrs[i]
                seg = tags[i]
                if a:
                    if a.get("id"):
                        seg += "#" + escape_token(a["id"])
                    if c := a.get("class"):
                        seg += self.class_tokens(c)
                segments.append(f"{seg}:{nth[i]}" if per_type[(parent[i], tags[i])] > 1 else seg + ":1!")
            most += sum(map(len, segments)) + n
        if "anc_ids" in want:
            most += n
        whole = n * most <= BATCH_BYTES
        step = max(1, BATCH_BYTES // most)
        paths, lines = [], []
        if whole:  # small enough to keep what is above every element
            for i in range(n) if "path" in want else ():
                paths.append(paths[parent[i]] + "/" + segments[i] if parent[i] >= 0 else segments[i])
            for up in parent if "anc_ids" in want else ():
                lines.append([*lines[up], up] if up >= 0 else [])

        def above(i: int) -> list[int]:
            if whole and lines:
                return lines[i]
            out = []
            while (i := parent[i]) >= 0:
                out.append(i)
            return out[::-1]

        def text_of(i: int) -> str:
            a, b = tree.seen_from[i], tree.seen_to[i]
            t = "".join(tree.pieces[a:b]).strip() if b > a and not tree.hidden[i] else ""
            if not t:
                a, b = tree.all_from[i], tree.all_to[i]
                t = "".join(tree.all_text[a:b]).strip() if b > a else ""
            return t

        def own_text(i: int) -> str:
            own = tree.own[i]
            if own is None:
                return ""
            return _SPACE.sub(" ", "".join(own)).strip() if tags[i] not in RAW else "".join(own).strip()

        lists = {
            "end_id": tree.end, "parent_id": parent, "depth": depth, "sib_pos": sib, "nth_of_type": nth, "n_kids": kids,
            "tag": tags, "n_links": links, "n_imgs": imgs, "hidden": tree.hidden,
        }
        for at in range(0, len(keep), step):
            part = keep[at: at + step]
            texts = [text_of(i) for i in part] if "text" in want or "text_len" in want else []
            size, made = 200 * len(part), {}
            for c in self.columns:
                if c in lists:
                    source_list = lists[c]
                    made[c] = [source_list[i] for i in part]
                elif c == "node_id":
                    made[c] = part
                elif c == "text":
                    made[c] = texts
                elif c == "text_len":
                    made[c] = [len(t) for t in texts]
                elif c == "attrs":
                    made[c] = [list(attrs[i].items()) for i in part]
                elif c == "own_text":
                    made[c] = [own_text(i) for i in part]
                elif c == "path":
                    made[c] = [paths[i] for i in part] if whole else ["/".join([segments[j] for j in (*above(i), i)]) for i in part]
                elif c == "anc_ids":
                    made[c] = [above(i) for i in part]
                elif c == "type_count":
                    made[c] = [per_type[(parent[i], tags[i])] for i in part]
                elif c == "sib_count":
                    made[c] = [kids[parent[i]] if parent[i] >= 0 else 1 for i in part]
                elif c == "elem_id":
                    made[c] = [attrs[i].get("id") or None for i in part]
                elif c == "classes":
                    made[c] = [attrs[i]["class"].split() if attrs[i].get("class") else [] for i in part]
                elif c == "inner_html":
                    made[c] = [source[tree.inner[i]:tree.inner_end[i]] for i in part]
                elif c == "outer_html":
                    made[c] = [source[tree.begin[i]:tree.close[i]] for i in part]
                if c in HEAVY:
                    size += sum(map(len, made[c]))
            if self.size + size > BATCH_BYTES and self.size:  # also inside a page: no batch outgrows its bound
                yield self.emit()
                rows = self.rows
            self.size += size
            rows["page_id"].extend([page_id] * len(part))
            for c, v in zip(self.carry, carried):
                rows[c].extend([v] * len(part))
            for c, values in made.items():
                rows[c].extend(values)

    def emit(self) -> pa.RecordBatch:
        arrays = [pa.array(self.rows[f.name], type=f.type) for f in self.schema]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


_ARROW = {
    "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string()),
}
#: Counted bytes of a batch; its rows as Python values take ten times that.
BATCH_BYTES = 4 << 20
#: Columns whose length counts.
HEAVY = frozenset(["path", "anc_ids", "inner_html", "outer_html", "text"])
BASE_COLUMNS = ("node_id", "end_id", "parent_id", "depth", "sib_pos", "nth_of_type", "tag")
ALL_COLUMNS = tuple(NODE_FIELDS)


def html_nodes(
    pages: DataFrame,
    columns: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Element rows of every page, in document order of ``node_id``.

    ``columns`` and ``tags`` are the projection and the tag filter of the scan:
    Catalyst cannot push either through the Arrow worker, so callers name what
    they read and nothing else is built or shipped to the JVM. Subtree columns
    are offered as counts (``n_links``, ``n_imgs``, ``text_len``) so that most
    operators never need the text of large elements. ``carry`` repeats string
    columns of the page (its ``url``) on every row, which saves a join later.

    A page whose markup cannot be read gives one row with tag ``#error``.
    """
    chosen = [c for c in NODE_FIELDS if c in set(columns)] if columns is not None else [
        c for c in NODE_FIELDS if c not in ("inner_html", "outer_html")
    ]
    carry = tuple(carry)
    schema = pa.schema(
        [pa.field("page_id", pa.int64())]
        + [pa.field(c, pa.string()) for c in carry]
        + [pa.field(c, _ARROW[NODE_FIELDS[c]]) for c in chosen]
    )
    ddl = ", ".join(
        ["page_id bigint"] + [f"{c} string" for c in carry] + [f"{c} {NODE_FIELDS[c]}" for c in chosen]
    )
    wanted = frozenset(tags) if tags is not None else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batch(chosen, wanted, carry, schema)
        for batch in batches:
            extra = [batch.column(i + 2).to_pylist() for i in range(len(carry))]
            for at, (page_id, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = source.as_py()
                if not text:
                    continue
                carried = tuple(e[at] for e in extra)
                try:
                    tree = build_tree(text)
                except (RecursionError, ValueError, IndexError, KeyError) as exc:
                    tree = _Tree()
                    tree.push("#error", {}, 0, 0)
                    tree.text(f"{type(exc).__name__}: {exc}")
                    tree.pop(0, 0)
                yield from out.add(page_id, carried, text, tree)
        if out.rows["page_id"]:
            yield out.emit()

    return pages.select("page_id", "html", *carry).mapInArrow(parse, ddl)
