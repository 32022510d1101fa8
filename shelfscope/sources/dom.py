"""Element lookup in one HTML page: the helper the Arrow pass of ``candidates`` runs inside its tasks.

It covers the selector forms the extraction layouts use and no more: type, ``#id``, ``.class``,
``[attr]`` with ``=``, ``*=`` and ``^=``, ``:not()``, ``:first-child``, ``:nth-child(n)``, the descendant
and ``~`` combinators, and comma lists. Tree rules: void elements close at once, a stray end tag is ignored, an
unclosed element ends with its parent, ``<p>`` closes nothing by itself.

Plain markup, which is nearly all of a page, is cut into tags and texts right here; from the first place that is not plain
on, ``HTMLParser`` reads the rest, so both ways give the same tree. What follows from a tag as it is written, its attributes
and the selectors it can end, is worked out once per worker and remembered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

# Elements that never have content, and elements whose text is not page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
HIDDEN = frozenset("rp rt script style template".split())

_COMPOUND = re.compile(
    r"""(?P<tag>[a-z][a-z0-9]*) | \#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+)
      | \[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)"(?P<val>[^"]*)")?\]
      | :not\((?P<no>[^)]+)\) | :nth-child\((?P<nth>\d+)\) | (?P<first>:first-child)""",
    re.X,
)


# A character number too long to be read as a number. This noncharacter takes its place, and what holds it is broken.
_BROKEN = re.compile(r"&#[0-9]{4301,};?")
BROKEN = "\ufdd0"

# A start tag, an end tag and an attribute that every reading rule reads alike.
_START = re.compile(
    r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:="[^"]*"|='[^']*'|=[^\s"'=<>`/&]+(?=[\s>]))?)*)[ \t\n\r\f]*(/?)>"""
)
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=("[^"]*"|'[^']*'|[^\s"'=<>`/&]+))?""")
#: Elements whose content is read by rules of its own, and all blanks that text of the page can be folded from.
RAW, CODED = frozenset(("script", "style")), frozenset(("title", "textarea"))
OWN_RULES = RAW | CODED | frozenset("iframe noembed noframes plaintext xmp".split())
BLANKS = "\n\t\x0c\r "
#: Tags remembered by a worker, of so many characters at most.
REMEMBERED, SHORT = 20_000, 1_000

_WORDS = re.compile(r"(?:\[[^\]]*\]|\S)+")
_ORDER = attrgetter("order")


class Shape:
    """A start tag as written: what all elements that are written so have in common."""

    __slots__ = ("tag", "attrs", "classes", "single", "known", "sign", "fitting")

    def __init__(self, tag: str, attrs: dict, single: bool):
        self.tag, self.attrs, self.single = tag, attrs, single
        self.classes = (attrs.get("class") or "").split()
        self.known, self.sign, self.fitting = 0, 0, {}

    def signature(self) -> int:
        """A number for the set of compounds that fit, child numbers apart, among all compiled until now; 0 for none."""
        if self.known != len(_CHAINS):
            found = frozenset(c[-1] for key in self._names() for c in _BY_PICK.get(key, ()) if self.fits(c))
            self.known, self.sign = len(_CHAINS), _SIGNS.setdefault(found, len(_SIGNS))
            _FITTING[self.sign] = found
        return self.sign

    def _names(self):
        yield None, None
        yield "tag", self.tag
        if "id" in self.attrs:
            yield "id", self.attrs["id"]
        for name in set(self.classes):
            yield "class", name

    def fits(self, compound: tuple) -> bool:
        """Whether the compound fits, child numbers apart."""
        number = compound[-1]
        fit = self.fitting.get(number)
        if fit is None:
            fit = self.fitting[number] = _shape_fits(self, compound)
        return fit


class State:
    """What selectors know of an element's ancestors and itself: (chain, step) of the steps that one of them ends."""

    __slots__ = ("reached", "next")

    def __init__(self, reached: frozenset):
        self.reached, self.next = reached, {}

    def after(self, sign: int) -> tuple:
        """The state of a child with these fitting compounds, and the numbers of the chains that it ends."""
        fitting, reached, ends = _FITTING[sign], set(self.reached), []
        for chain in _CHAINS:
            if not chain.below:
                if chain.steps[-1][1][-1] in fitting:
                    ends.append(chain.number)
                continue
            last = len(chain.steps) - 1
            for at, (_, compound) in enumerate(chain.steps):
                if compound[-1] in fitting and (not at or (chain.number, at - 1) in self.reached):
                    if at == last:
                        ends.append(chain.number)
                    else:
                        reached.add((chain.number, at))
        known = frozenset(reached)
        found = self.next[sign] = (_STATES.setdefault(known, State(known)), tuple(ends))
        return found


class Element:
    """Knows its parent and left sibling but not its children, so a page has no reference cycles."""

    __slots__ = ("tag", "shape", "parent", "left", "order", "last", "nth", "t0", "t1")

    def __init__(self, shape, parent, left, order, t0):
        self.tag, self.shape, self.parent, self.left, self.order, self.t0 = shape.tag, shape, parent, left, order, t0
        self.last, self.t1, self.nth = order, t0, 1 if left is None else left.nth + 1

    @property
    def attrs(self) -> dict:
        return self.shape.attrs

    @property
    def classes(self) -> list[str]:
        return self.shape.classes

    def get(self, name):
        return self.shape.attrs.get(name) or ""


#: Start tags as written to their shapes, end tags to their names.
_SHAPES: dict[str, Shape] = {}
_NAMES: dict[str, str] = {}


def _remember(known: dict, raw: str, value) -> None:
    if len(raw) <= SHORT:
        if len(known) >= REMEMBERED:
            known.clear()
        known[raw] = value


def _shape(found: re.Match) -> Shape:
    tag, written, single = found.groups()
    attrs = {}
    for name, value in _ATTRIBUTE.findall(written):
        if value:
            value = value[1:-1] if value[0] in "'\"" else value
            attrs[name.lower()] = unescape(value) if "&" in value else value
        else:
            attrs[name.lower()] = None
    return Shape(tag.lower(), attrs, bool(single))


class Page(HTMLParser):
    """Elements in document order, with the text pieces each one spans."""

    def __init__(self, html: str):
        self.texts: list[tuple[str, str | None]] = []
        self.elements: list[Element] = []
        self._pending: list[str] = []
        self._open = [Element(_ROOT, None, None, -1, 0)]
        self._newest = [None]  # per open element, its latest child
        self._hidden: list[Element] = []
        self._indexed, self._ends = 0, {}
        if "&#" in html:
            html = _BROKEN.sub(BROKEN, html)
        rest = self._plain(html)
        if rest < len(html):
            super().__init__(convert_charrefs=True)
            self.feed(html[rest:])
            self.close()
        self._flush()
        while self._open:
            self._end()
        self.broken = self._broken_places() if BROKEN in html else []

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    # building -------------------------------------------------------------------------------
    def _plain(self, html: str) -> int:
        """Read plain markup; where it ends. The text before that place is pending."""
        find, at, size, held = html.find, 0, len(html), None
        texts, elements, opened, newest, hidden = self.texts, self.elements, self._open, self._newest, self._hidden
        while at < size:
            begin = find("<", at)
            if begin != at:
                held = html[at:] if begin < 0 else html[at:begin]
                if "&" in held:
                    held = unescape(held)
                if begin < 0:
                    at = size
                    break
                at = begin
            close = find(">", begin)
            if close < 0:
                break
            raw = html[begin : close + 1]
            shape, name = _SHAPES.get(raw), None
            if shape is None:
                name = _NAMES.get(raw)
                if name is None:
                    if raw[1] == "/":
                        found = _END.fullmatch(raw)
                        if found is None:
                            break
                        name = found[1].lower()
                        _remember(_NAMES, raw, name)
                    elif raw[1] == "!":
                        end = self._past_comment(html, begin, raw)
                        if end < 0:
                            break
                        if held is not None:
                            self._put(held)
                            held = None
                        at = end
                        continue
                    else:
                        found = _START.match(html, begin)
                        if found is None:
                            break
                        shape = _shape(found)
                        if close == found.end() - 1:
                            _remember(_SHAPES, raw, shape)
                        close = found.end() - 1
            end, inner = close + 1, None
            if name is None and shape.tag in OWN_RULES and not shape.single:
                end, inner = self._own_text(html, shape.tag, end)
                if end < 0:
                    break
            if held is not None:
                if held.strip(BLANKS):
                    texts.append((held, hidden[-1].tag if hidden else None))
                else:
                    self._put(held)
                held = None
            if name is not None:
                if opened[-1].tag == name and len(opened) > 1:
                    element = opened.pop()
                    newest.pop()
                    element.last, element.t1 = len(elements) - 1, len(texts)
                    if hidden and hidden[-1] is element:
                        hidden.pop()
                else:
                    self.handle_endtag(name)
            else:
                self._start(shape)
                if inner is not None:
                    if inner:
                        self._put(inner)
                    self._end()
                elif shape.single and shape.tag not in VOID:
                    self._end()
            at = end
        if held is not None:
            self._pending.append(held)
        return at

    @staticmethod
    def _own_text(html: str, tag: str, at: int) -> tuple[int, str]:
        """Where an element ends that all rules agree holds nothing but text, and that text; else -1."""
        found = re.compile(rf"</{tag}[ \t\n\r\f]*>", re.I).search(html, at)
        if found is None or tag == "plaintext":
            return -1, ""
        text = html[at : found.start()]
        if tag in RAW:
            return (-1, "") if "<!--" in text or re.search(rf"</\s*{tag}", text, re.I) else (found.end(), text)
        if "<" in text or "&" in text and tag not in CODED:
            return -1, ""
        return found.end(), unescape(text) if "&" in text else text

    @staticmethod
    def _past_comment(html: str, at: int, raw: str) -> int:
        """Where a comment or document type that all rules end alike has ended, else -1."""
        if raw[:9].lower() == "<!doctype":
            return at + len(raw)
        if raw.startswith("<!--") and not html.startswith((">", "->"), at + 4):
            end = html.find("--", at + 4)
            if end >= 0 and html.startswith("-->", end):
                return end + 3
        return -1

    def _put(self, text: str) -> None:
        if not text.strip(BLANKS) and not any(e.tag in ("pre", "textarea") for e in self._open):
            text = "\n" if "\n" in text else " "
        self.texts.append((text, self._hidden[-1].tag if self._hidden else None))

    def _flush(self):
        if self._pending:
            text = "".join(self._pending)
            self._pending = []
            self._put(text)

    def _end(self):
        element = self._open.pop()
        self._newest.pop()
        element.last, element.t1 = len(self.elements) - 1, len(self.texts)
        if self._hidden and self._hidden[-1] is element:
            self._hidden.pop()

    def _start(self, shape: Shape):
        if self._pending:
            self._flush()
        newest, elements = self._newest, self.elements
        element = Element(shape, self._open[-1], newest[-1], len(elements), len(self.texts))
        newest[-1] = element
        elements.append(element)
        tag = shape.tag
        if tag in VOID:
            return
        self._open.append(element)
        newest.append(None)
        if tag in HIDDEN:
            self._hidden.append(element)

    def handle_starttag(self, tag, attrs):
        self._start(Shape(tag, dict(attrs), False))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag):
        if self._pending:
            self._flush()
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at].tag == tag:
                while len(self._open) > at:
                    self._end()
                return

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    # reading --------------------------------------------------------------------------------
    def _broken_places(self) -> list[int]:
        """Of each broken piece of text or attribute, the number of the element that holds it."""
        texts = [max((e for e in self.elements if e.t0 <= i < e.t1), key=_ORDER, default=None) for i, (t, _) in enumerate(self.texts) if BROKEN in t]
        return [-1 if e is None else e.order for e in texts] + [e.order for e in self.elements if any(BROKEN in (v or "") for v in e.attrs.values())]

    def is_broken(self, element) -> bool:
        return any(element.order <= at <= element.last for at in self.broken)

    def raw_text(self, element) -> str:
        """Text as written, line breaks included."""
        own = element.tag if element.tag in HIDDEN else None
        return "".join([t for t, hidden in self.texts[element.t0 : element.t1] if hidden == own])

    def text(self, element) -> str:
        """Every piece of text trimmed, then joined with nothing between."""
        own = element.tag if element.tag in HIDDEN else None
        return "".join([t.strip() for t, hidden in self.texts[element.t0 : element.t1] if hidden == own])

    def tagged(self, tag: str) -> list[Element]:
        return [e for e in self.elements if e.tag == tag]

    def select(self, selector: str, scope: Element | None = None) -> list[Element]:
        """Matches below ``scope`` in document order; ancestors named in the selector may lie above it."""
        chains = compiled(selector)
        if len(chains) == 1:
            return list(self._matches(chains[0], scope))
        found = {e.order: e for chain in chains for e in self._matches(chain, scope)}
        return [found[k] for k in sorted(found)]

    def one(self, selector: str, scope: Element | None = None) -> Element | None:
        """The first match."""
        chains = _COMPILED.get(selector) or compiled(selector)
        if self._indexed != len(_CHAINS):
            self._index()
        best = None
        for chain in chains:
            pool = self._ends.get(chain.number)
            if pool is not None:
                for e in pool if scope is None else self._within(pool, scope):
                    if chain.below or _chain_fits(e, chain.steps, len(chain.steps) - 1):
                        if best is None or e.order < best.order:
                            best = e
                        break
        return best

    def first_texts(self, selectors: list[str], scope: Element | None = None) -> list[str | None]:
        """The text of each selector's first match."""
        out = []
        for selector in selectors:
            chains = _COMPILED.get(selector) or compiled(selector)
            if self._indexed != len(_CHAINS):
                self._index()
            if len(chains) == 1 and chains[0].number not in self._ends:
                out.append(None)
            else:
                e = self.one(selector, scope)
                out.append(None if e is None else self.text(e))
        return out

    def _index(self):
        """Elements by the chains that they end; those of chains with siblings or child numbers are still to be tested."""
        known, ends = len(_CHAINS), {}
        if _STATES.get(None) != known or len(_STATES) > REMEMBERED:
            _STATES.clear()
            _STATES[None] = known
        states = [_STATES.setdefault(frozenset(), State(frozenset()))] * (len(self.elements) + 1)  # the last stands above the page
        for e in self.elements:
            shape = e.shape
            sign = shape.sign if shape.known == known else shape.signature()
            state = states[e.parent.order]
            if sign:
                state, ended = state.next.get(sign) or state.after(sign)
                for n in ended:
                    if n in ends:
                        ends[n].append(e)
                    else:
                        ends[n] = [e]
            states[e.order] = state
        self._indexed, self._ends = known, ends

    @staticmethod
    def _within(pool: list[Element], scope: Element) -> list[Element]:
        low, high = scope.order, scope.last
        if len(pool) > 8:
            return pool[bisect_right(pool, low, key=_ORDER) : bisect_right(pool, high, key=_ORDER)]
        return [e for e in pool if low < e.order <= high]

    def _matches(self, chain, scope) -> list[Element]:
        if self._indexed != len(_CHAINS):
            self._index()
        pool = self._ends.get(chain.number)
        if pool is None:
            return []
        if scope is not None:
            pool = self._within(pool, scope)
        return pool if chain.below else [e for e in pool if _chain_fits(e, chain.steps, len(chain.steps) - 1)]


class Chain:
    """One alternative of a selector: steps of (combinator to the left neighbour, compound)."""

    __slots__ = ("number", "steps", "below")

    def __init__(self, number: int, steps: list):
        self.number, self.steps = number, steps
        numbered = any(c[5] or any(other[5] for other in c[4]) for _, c in steps)
        self.below = not numbered and all(link == " " for link, _ in steps)  # tags and ancestors tell it all


_COMPILED: dict[str, list[Chain]] = {}
_CHAINS: list[Chain] = []
#: Compounds by a name that they ask for, and all of them.
_BY_PICK: dict[tuple, list[tuple]] = {}
_COMPOUNDS: list[tuple] = []
#: Sets of fitting compounds by number, and the states met; both follow from the selectors and are few.
_SIGNS: dict[frozenset, int] = {frozenset(): 0}
_FITTING: dict[int, frozenset] = {0: frozenset()}
_STATES: dict = {}


def compiled(selector: str) -> list[Chain]:
    """The alternatives of a selector."""
    chains = _COMPILED.get(selector)
    if chains is not None:
        return chains
    chains = []
    for part in selector.split(","):
        steps, link = [], " "
        for word in _WORDS.findall(part):
            if word == "~":
                link = "~"
            else:
                steps.append((link, _compound(word)))
                link = " "
        chain = Chain(len(_CHAINS), steps)
        for _, compound in steps:
            tag, id_, names, *_ = compound
            pick = ("id", id_) if id_ else ("class", names[0]) if names else ("tag", tag) if tag else (None, None)
            _BY_PICK.setdefault(pick, []).append(compound)
        _CHAINS.append(chain)
        chains.append(chain)
    _COMPILED[selector] = chains
    return chains


def _compound(word: str) -> tuple:
    """(tag, id, classes, attribute tests, negated compounds, child number, number of its own)"""
    tag = id_ = nth = None
    classes, attrs, no = [], [], []
    for m in _COMPOUND.finditer(word):
        if m["tag"]:
            tag = m["tag"]
        elif m["id"]:
            id_ = m["id"]
        elif m["cls"]:
            classes.append(m["cls"])
        elif m["attr"]:
            attrs.append((m["attr"], m["op"], m["val"]))
        elif m["no"]:
            no.append(_compound(m["no"]))
        else:
            nth = int(m["nth"] or 1)
    made = (tag, id_, classes, attrs, no, nth, len(_COMPOUNDS))
    _COMPOUNDS.append(made)
    return made


def _shape_fits(shape: Shape, compound: tuple) -> bool:
    tag, id_, classes, attrs, no, _, _ = compound
    if tag and shape.tag != tag or id_ and shape.attrs.get("id") != id_:
        return False
    for name in classes:
        if name not in shape.classes:
            return False
    for name, op, want in attrs:
        if name not in shape.attrs:
            return False
        have = " ".join(shape.classes) if name == "class" else shape.attrs[name] or ""
        if op == "=" and have != want or op == "*=" and want not in have or op == "^=" and not have.startswith(want):
            return False
    return not any(other[5] is None and _shape_fits(shape, other) for other in no)


def _fits(e: Element, compound: tuple) -> bool:
    """A negated compound with a child number cannot be told from the tag alone."""
    if not e.shape.fits(compound) or compound[5] and e.nth != compound[5]:
        return False
    return not any(other[5] is not None and _fits(e, other) for other in compound[4])


def _chain_fits(e: Element, steps, at: int) -> bool:
    link, compound = steps[at]
    if not _fits(e, compound):
        return False
    if at == 0:
        return True
    beside = link == "~"
    other = e.left if beside else e.parent
    while other is not None and other.order >= 0:
        if _chain_fits(other, steps, at - 1):
            return True
        other = other.left if beside else other.parent
    return False


_ROOT = Shape("", {}, False)
