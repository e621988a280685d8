"""HTML trees: a tokenizer, a tree builder for the parts of HTML5 that pages use, and the serializer."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
#: Elements whose content is text alone.
TEXTUAL = RAW | RCDATA | {"plaintext"}
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p "
    "search section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr plaintext".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements beside blocks that reopen no formatting.
APART = frozenset("li dd dt tr td th tbody thead tfoot caption col colgroup script style".split())
TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption colgroup col".split())
SCOPE = frozenset("applet caption html table td th marquee object template svg math foreignobject".split())
#: Foreign names whose case the parser restores.
FOREIGN_TAGS = {x.lower(): x for x in "clipPath foreignObject linearGradient radialGradient textPath feGaussianBlur feOffset feBlend feMerge feMergeNode feColorMatrix feComposite feFlood feImage animateMotion animateTransform".split()}
FOREIGN_ATTRS = {x.lower(): x for x in "viewBox preserveAspectRatio gradientUnits gradientTransform patternUnits clipPathUnits maskUnits markerWidth markerHeight refX refY stdDeviation textLength lengthAdjust pathLength attributeName repeatCount spreadMethod startOffset baseFrequency numOctaves xChannelSelector yChannelSelector".split()}
#: Elements open at once, as browsers limit it too.
MAX_DEPTH = 512
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|))?""")
_COMMENT_END = re.compile("--!?>")
_LOOSE = re.compile(r"&(#[xX]?[0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)(?=(.?))", re.DOTALL)


@dataclass(eq=False, slots=True)
class Node:
    kind: str  # document, element, text, comment, doctype
    name: str = ""
    attrs: list[list[str]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    text: str = ""
    parent: Node | None = None
    foreign: bool = False
    own: bool = False  # made by a writer, not parsed: a void element then has an end tag

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name: str) -> str | None:
        for n, v in self.attrs:
            if n == name or n.rpartition(":")[2] == name:
                return v
        return None

    def set(self, name: str, value: str | None) -> None:
        hits = [a for a in self.attrs if a[0] == name or a[0].rpartition(":")[2] == name]
        if value is None:
            self.attrs = [a for a in self.attrs if a not in hits]
        elif hits:
            for a in hits:
                a[1] = value
        else:
            self.attrs.append([name, value])

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.kind == "element" and c.name == name), None)


def _attr_text(value: str) -> str:
    def one(m: re.Match) -> str:
        whole, after = m[0], m[2]
        if not whole.endswith(";") and not m[1].startswith("#") and (after == "=" or after.isalnum()):
            return whole
        return _html.unescape(whole)

    return _LOOSE.sub(one, value) if "&" in value else value


def tokens(text: str):
    """(kind, name or text, attributes, self-closing) of the text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at, n, low = 0, len(text), None
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            yield "text", _html.unescape(text[at:]), None, False
            return
        if lt > at:
            yield "text", _html.unescape(text[at:lt]), None, False
            at = lt
        if found := _TAG.match(text, at):
            closing, name = found[1] == "/", found[2].lower()
            at, attrs, seen, void = found.end(), [], set(), False
            if text.startswith(">", at):
                at += 1
            else:
                while m := _ATTR.match(text, at):
                    key = m[1].lower()
                    value = next((g for g in m.groups()[1:] if g is not None), "")
                    if key not in seen:
                        seen.add(key)
                        attrs.append([key, _attr_text(value)])
                    at = m.end()
                end = text.find(">", at)
                if end < 0:
                    return
                void = "/" in text[at:end]
                at = end + 1
            yield ("end" if closing else "start"), name, attrs, void
            if not closing and name in TEXTUAL:
                low = text.lower() if low is None else low
                stop = at
                while True:
                    stop = low.find("</" + name, stop)
                    after = low[stop + 2 + len(name) : stop + 3 + len(name)]
                    if stop < 0 or name == "plaintext":
                        stop = n
                        break
                    if after in ("", ">", "/", " ", "\n", "\t", "\f"):
                        break
                    stop += 2
                if stop > at:
                    body = text[at:stop]
                    yield "raw", _html.unescape(body) if name in RCDATA else body, None, False
                at = stop
        elif text.startswith("<!--", at):
            if text.startswith((">", "->"), at + 4):
                end, stop = at + 4, text.index(">", at) + 1
            else:
                found = _COMMENT_END.search(text, at + 4)
                end, stop = (found.start(), found.end()) if found else (n, n)
            yield "comment", text[at + 4 : end], None, False
            at = stop
        elif text.startswith(("<!", "<?", "</"), at):
            end = text.find(">", at)
            end = n if end < 0 else end
            body = text[at + 2 : end]
            if text.startswith("<!", at) and body[:7].lower() == "doctype":
                yield "doctype", body[7:].strip(), None, False
            elif text.startswith("</", at):
                if at + 2 >= n:
                    yield "text", "</", None, False
                elif body:
                    yield "comment", body, None, False
            else:
                yield "comment", text[at + 1 : end] if text[at + 1] == "?" else body, None, False
            at = end + 1
        else:
            yield "text", "<", None, False
            at += 1


class _Stack(list):
    """Open elements, and how many there are of each name."""

    def __init__(self, nodes=()):
        super().__init__(nodes)
        self.names = Counter(x.name for x in self)

    def append(self, node: Node) -> None:
        super().append(node)
        self.names[node.name] += 1

    def pop(self) -> Node:
        node = super().pop()
        self.names[node.name] -= 1
        return node

    def __delitem__(self, part: slice) -> None:
        self.names.subtract(x.name for x in self[part])
        super().__delitem__(part)

    def has(self, names) -> bool:
        for n in names:
            if self.names[n]:
                return True
        return False


class _Builder:
    def __init__(self):
        self.document = Node("document")
        self.html = self.head = self.body = None
        self.stack = _Stack()
        self.formats: list[Node] = []
        self.frameset = self.after_head = False

    def make(self, name: str, attrs=None, foreign=False) -> Node:
        if foreign:
            name = FOREIGN_TAGS.get(name, name)
            attrs = [[FOREIGN_ATTRS.get(k, k), v] for k, v in attrs or []]
        return Node("element", name, attrs or [], foreign=foreign)

    @property
    def top(self) -> Node:
        return self.stack[-1] if self.stack else self.document

    def need_html(self, attrs=None) -> None:
        if self.html is None:
            self.html = self.document.append(self.make("html", attrs))
            self.stack = _Stack([self.html])

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.html.append(self.make("head"))

    def need_body(self, attrs=None) -> None:
        self.need_head()
        if self.body is None and not self.frameset:
            self.body = self.html.append(self.make("body", attrs))
            self.stack = _Stack([self.html, self.body])

    def insert(self, node: Node, push: bool) -> None:
        if push and len(self.stack) >= MAX_DEPTH:
            self.stack.pop()
        where = self.top
        if where.name in ("table", "tbody", "thead", "tfoot", "tr") and not where.foreign and node.kind != "comment":
            fits = node.name in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th", "script", "style", "template", "form", "input")
            if not fits and not (node.kind == "text" and not node.text.strip()):
                table = next((x for x in reversed(self.stack) if x.name == "table"), None)
                if table and table.parent:  # foster parenting
                    parent = table.parent
                    node.parent = parent
                    parent.children.insert(parent.children.index(table), node)
                    if push:
                        self.stack.append(node)
                    return
        if node.kind == "text" and where.children and where.children[-1].kind == "text":
            where.children[-1].text += node.text
            return
        where.append(node)
        if push:
            self.stack.append(node)

    def in_scope(self, names, extra=()) -> bool:
        if not self.stack.has(names):
            return False
        for x in reversed(self.stack):
            if x.name in names:
                return True
            if x.name in SCOPE or x.name in extra:
                return False
        return False

    def pop_to(self, names) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().name in names:
                return

    def reconstruct(self) -> None:
        """Reopens the formatting elements that a block has closed."""
        pending = []
        for x in reversed(self.formats):
            if x.name == "#marker" or x in self.stack:
                break
            pending.append(x)
        for x in reversed(pending):
            node = self.make(x.name, [list(a) for a in x.attrs])
            self.insert(node, True)
            self.formats[self.formats.index(x)] = node

    def start(self, name: str, attrs, void: bool) -> None:
        if name == "html":
            if self.html is None:
                self.need_html(attrs)
            else:
                self.html.attrs += [a for a in attrs if self.html.get(a[0]) is None]
            return
        self.need_html()
        foreign = self.top.foreign and self.top.name not in ("foreignObject", "desc", "title")
        if foreign:
            if name in BLOCK | FORMAT | {"img", "br", "body", "head", "span", "li", "meta", "dd", "dt"} - {"a", "font"}:
                while self.top.foreign:
                    self.stack.pop()
            else:
                self.insert(self.make(name, attrs, True), not void)
                return
        if self.body is None and not self.frameset:
            if name == "head":
                if self.head is None:
                    self.head = self.html.append(self.make("head", attrs))
                return
            if name in HEAD:
                self.need_head()
                node = self.head.append(self.make(name, attrs))
                if name not in VOID:
                    self.stack = _Stack([self.html, self.head, node])
                return
            if name == "frameset":
                self.need_head()
                self.frameset = True
                self.stack = _Stack([self.html])
                self.insert(self.make(name, attrs), True)
                return
            if name == "body":
                self.need_body(attrs)
                return
            self.need_body()
        if self.frameset:
            if name in ("frameset", "frame", "noframes"):
                self.insert(self.make(name, attrs), name != "frame")
            return
        if name == "body":
            self.body.attrs += [a for a in attrs if self.body.get(a[0]) is None]
            return
        if name in ("head", "frameset", "frame"):
            return
        if name in BLOCK and self.in_scope(("p",), ("button",)):
            self.pop_to(("p",))
        if name in HEADINGS and self.top.name in HEADINGS:
            self.stack.pop()
        if name in ("li", "dd", "dt"):
            group = ("li",) if name == "li" else ("dd", "dt")
            for x in reversed(self.stack) if self.stack.has(group) else ():
                if x.name in group:
                    self.pop_to(group)
                    break
                if x.name in SCOPE or (x.name in BLOCK and x.name not in ("address", "div", "p")):
                    break
            if self.in_scope(("p",), ("button",)):
                self.pop_to(("p",))
        if name in ("option", "optgroup") and self.top.name == "option":
            self.stack.pop()
        if name in TABLE_PARTS:
            self._table(name)
        if name in ("a", "nobr"):
            old = next((x for x in reversed(self.formats) if x.name in (name, "#marker")), None)
            if old and old.name == name:
                self.end(name)
                if old in self.formats:
                    self.formats.remove(old)
        if name in FORMAT or name not in BLOCK and name not in APART:
            self.reconstruct()
        node = self.make("img" if name == "image" else name, attrs, name in ("svg", "math"))
        closed = name in VOID or node.foreign and void
        self.insert(node, not closed)
        if name in FORMAT:
            self._remember(node)
        elif name in ("applet", "marquee", "object", "td", "th", "caption"):
            self.formats.append(Node("element", "#marker"))

    def _remember(self, node: Node) -> None:
        """Of equal formatting elements, three at most are opened again."""
        equal = []
        for x in reversed(self.formats):
            if x.name == "#marker":
                break
            if x.name == node.name and sorted(x.attrs) == sorted(node.attrs):
                equal.append(x)
        if len(equal) >= 3:
            self.formats.remove(equal[2])
        self.formats.append(node)

    def _table(self, name: str) -> None:
        if not self.stack.has(("table",)):
            return
        if name in ("td", "th"):
            if self.in_scope(("td", "th")):
                self._close_cell()
            if self.top.name in ("tbody", "thead", "tfoot", "table"):
                self._table("tr")
                self.insert(self.make("tr"), True)
            return
        if self.in_scope(("td", "th")):
            self._close_cell()
        if self.in_scope(("tr",)):
            self.pop_to(("tr",))
        if name == "tr":
            if self.top.name == "table":
                self.insert(self.make("tbody"), True)
        elif self.in_scope(("tbody", "thead", "tfoot")):
            self.pop_to(("tbody", "thead", "tfoot"))

    def _close_cell(self) -> None:
        self.pop_to(("td", "th"))
        self._clear_marker()

    def _clear_marker(self) -> None:
        while self.formats and self.formats.pop().name != "#marker":
            pass

    def end(self, name: str) -> None:
        if name in ("html", "body", "head"):
            if name == "head":
                self.need_head()
            return
        if name == "br":
            self.start("br", [], False)
            return
        if self.body is None and not self.frameset:
            if self.stack and self.top.name == name:
                self.stack = _Stack([self.html])
            elif name == "p":
                self.need_body()
                self.insert(self.make("p"), False)
            return
        if name == "p" and not self.in_scope(("p",), ("button",)):
            self.insert(self.make("p"), False)
            return
        if name in FORMAT:
            self._format_end(name)
            return
        names = HEADINGS if name in HEADINGS else (name, FOREIGN_TAGS.get(name, name))
        if self.in_scope(names):
            self.pop_to(names)
            if name in ("td", "th", "caption", "applet", "marquee", "object"):
                self._clear_marker()

    def _format_end(self, name: str) -> None:
        node = None
        for x in reversed(self.formats):
            if x.name == "#marker":
                break
            if x.name == name:
                node = x
                break
        if node is None or node not in self.stack:
            if node is not None:
                self.formats.remove(node)
            elif self.stack.has((name,)):
                self.pop_to((name,))
            return
        at = self.stack.index(node)
        block = next((x for x in self.stack[at:] if x.name in BLOCK or x.name in ("li", "dd", "dt", "td", "th", "button")), None)
        if block is None:
            del self.stack[at:]
            self.formats.remove(node)
            return
        # the block leaves the formatting element, which is opened again inside it around what it has so far
        parent = node.parent
        place = self.stack.index(block)
        block.parent.children.remove(block)
        spot = parent.children.index(node) + 1
        block.parent = parent
        parent.children.insert(spot, block)
        inner = self.make(node.name, [list(a) for a in node.attrs])
        for c in block.children:
            inner.append(c)
        block.children = []
        if inner.children:
            block.append(inner)
        self.formats.remove(node)
        del self.stack[at:place]

    def text(self, text: str) -> None:
        if self.body is None and not self.frameset:
            if self.stack and len(self.stack) > 2 and self.stack[1] is self.head:
                self.insert(Node("text", text=text), False)
                return
            if not text.strip(" \t\n\f"):
                if self.html is not None and self.head is not None:
                    (self.html if self.after_head else self.head).append(Node("text", text=text))
                return
            lead = text[: len(text) - len(text.lstrip(" \t\n\f"))]
            if lead and self.head is not None:
                (self.html if self.after_head else self.head).append(Node("text", text=lead))
            text = text[len(lead) :]
            self.need_body()
        if self.frameset:
            return
        if text.strip(" \t\n\f"):
            self.reconstruct()
        self.insert(Node("text", text=text), False)

    def comment(self, text: str) -> None:
        node = Node("comment", text=text)
        (self.top if self.stack else self.document).append(node)


def parse(text: str) -> Node:
    """The document's tree, with html, head and body as HTML implies them."""
    b = _Builder()
    for kind, value, attrs, void in tokens(text.removeprefix("\ufeff")):
        if kind == "text":
            b.text(value.replace("\0", ""))
        elif kind == "raw":
            if b.top.name in TEXTUAL:
                b.top.append(Node("text", text=value))
            else:
                b.text(value)
        elif kind == "start":
            b.start(value, attrs, void)
        elif kind == "end":
            if value == "head" and b.body is None:
                b.need_head()
                b.after_head = True
            b.end(value)
        elif kind == "comment":
            b.comment(value)
        elif kind == "doctype" and b.html is None:
            b.document.append(Node("doctype", text=(value.split() or ["html"])[0].lower()))
    b.need_body()
    return b.document


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def serialize(node: Node) -> str:
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == "text":
            plain = x.parent is not None and x.parent.name in RAW and not x.parent.foreign
            out.append(x.text if plain else _escape(x.text))
        elif x.kind == "comment":
            out.append(f"<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append(f"<!DOCTYPE {x.text}>")
        elif x.kind == "document":
            todo += reversed(x.children)
        else:
            attrs = x.attrs and "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs)
            out.append(f"<{x.name}{attrs or ''}>")
            if x.name in VOID and not x.own and not x.foreign:
                continue
            todo.append(f"</{x.name}>")
            todo += reversed(x.children)
    return "".join(out)


def element(document: Node, *path: str) -> Node | None:
    node = document
    for name in path:
        node = node.child(name) if node else None
    return node


def find_nodes(node: Node, path: list[str]) -> list[Node]:
    """Nodes at a child path, in any case; the path's endings match from each node on the way too."""
    found = []
    for at in range(len(path)):
        first, rest = path[at].lower(), path[at + 1 :]
        for c in node.children:
            if c.kind == "element" and c.name.lower() == first:
                found += find_nodes(c, rest) if rest else [c]
    return found


def head_nodes(document: Node, name: str) -> list[Node]:
    head = element(document, "html", "head")
    return [c for c in head.children if c.kind == "element" and c.name == name] if head else []


def base_url(document: Node) -> str | None:
    found = head_nodes(document, "base")
    return found[0].get("href") if found else None


def charset(document: Node) -> str | None:
    from pressleaf.functions.media import content_type

    for meta in head_nodes(document, "meta"):
        if (value := meta.get("charset")) is not None:
            return value
        if (meta.get("http-equiv") or "").lower() == "content-type" and (content := meta.get("content")) is not None:
            return content_type(content)[1]
    return None


def robots(document: Node) -> str | None:
    return next((m.get("content") for m in head_nodes(document, "meta") if (m.get("name") or "").lower() == "robots"), None)


def title(document: Node) -> str | None:
    for node in head_nodes(document, "title"):
        if text := next((c for c in node.children if c.kind == "text"), None):
            return text.text
    return None


def has_favicon(document: Node) -> bool:
    from pressleaf.functions.markup import is_favicon

    return any(is_favicon((x.get("rel") or "").strip()) for x in head_nodes(document, "link"))


def _new(name: str, *attrs: tuple[str, str]) -> Node:
    return Node("element", name, [list(a) for a in attrs], own=True)


def _into_head(document: Node, node: Node, first: bool = False) -> None:
    head = element(document, "html", "head")
    if head is not None:
        node.parent = head
        head.children.insert(0 if first else len(head.children), node)


def add_favicon(document: Node, url: str) -> None:
    _into_head(document, _new("link", ("rel", "icon"), ("href", url)))


def set_base_url(document: Node, href: str) -> None:
    found = head_nodes(document, "base")
    if found:
        found[0].set("href", href)
    else:
        _into_head(document, _new("base", ("href", href)))


def set_charset(document: Node, name: str) -> None:
    for meta in head_nodes(document, "meta"):
        if meta.get("charset") is not None:
            meta.set("charset", name)
            return
        if (meta.get("http-equiv") or "").lower() == "content-type" and meta.get("content") is not None:
            meta.set("content", f"text/html;charset={name}")
            return
    _into_head(document, _new("meta", ("charset", name)))


def set_robots(document: Node, content: str) -> None:
    for meta in head_nodes(document, "meta"):
        if (meta.get("name") or "").lower() == "robots":
            meta.set("content", content)
            return
    _into_head(document, _new("meta", ("name", "robots"), ("content", content)))


def add_policy(document: Node, text: str) -> None:
    if text:
        _into_head(document, _new("meta", ("http-equiv", "Content-Security-Policy"), ("content", text)), first=True)
