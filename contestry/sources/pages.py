"""HTML pages as rows: each extractor turns one page into records; Spark maps it over pages in Arrow batches.

A page that isn't of the kind gives no rows. Records hold text and whole numbers; what a page doesn't show is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends, where its own end was left out.
ENDS = {"tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",), "option": ("option",)}


class Node:
    """A tag. order is the page's list of all nodes as they begin; those inside this one stand from place + 1 up to end."""

    __slots__ = ("tag", "attrs", "parent", "children", "order", "place", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: list[Node]) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.order, self.place, self.end = order, len(order), 0
        order.append(self)

    def text(self) -> str:
        """All text inside, with single spaces."""
        parts: list[str] = []

        def walk(n: Node) -> None:
            for c in n.children:
                walk(c) if isinstance(c, Node) else parts.append(c)

        walk(self)
        return " ".join(" ".join(parts).replace("\xa0", " ").split())

    def has(self, name: str) -> bool:
        own = self.attrs.get("class")
        return own is not None and name in own and name in own.split()

    def all(self, tag: str | None = None, cls: str | None = None, test: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """Nodes inside, in the page's order."""
        for c in self.order[self.place + 1 : self.end]:
            if (tag is None or c.tag == tag) and (cls is None or c.has(cls)) and (test is None or test(c)):
                yield c

    def first(self, *what, **how) -> Node | None:
        return next(self.all(*what, **how), None)

    def cells(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag in ("td", "th")]


#: Tags whose inside is no markup, or is read by rules of its own.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_PLAIN = re.compile(r"""([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:=(?:"[^"&\0]*"|'[^'&\0]*'))?)*)[ \t\n\r\f]*|/([a-zA-Z][a-zA-Z0-9]*)""")
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)(?:=(?:"([^"]*)"|'([^']*)'))?""")


@lru_cache(1 << 12)
def plain_tag(inside: str) -> tuple[str, dict[str, str] | None] | None:
    """Name and attributes (None: an end) of a tag of the plainest form, from what stands between its angles; None of any other."""
    m = _PLAIN.fullmatch(inside)
    if m is None or (m[1] or m[3]).lower() in RAW:
        return None
    return (m[3].lower(), None) if m[3] else (m[1].lower(), {k.lower(): a or b for k, a, b in _ATTR.findall(m[2])})


class Page(HTMLParser):
    """A page's nodes. Pages of nothing but text and plain tags are split at their angles; all others go through the library's parser, whose
    events are the same."""

    def __init__(self, html: str) -> None:
        if not self.split(html):
            super().__init__(convert_charrefs=True)
            self.begin()
            self.feed(html)
            self.close()
        for n in reversed(self.order):  # children come before their parents
            n.end = max(n.end, n.place + 1)
            if n.parent is not None:
                n.parent.end = max(n.parent.end, n.end)

    def begin(self) -> None:
        self.order: list[Node] = []
        self.root = self.at = Node("", {}, None, self.order)

    def split(self, html: str) -> bool:
        """Whether all of the page was plain and is read."""
        self.begin()
        first, *rest = html.split("<")
        if first:
            self.handle_data(unescape(first))
        for piece in rest:
            inside, angle, text = piece.partition(">")
            tag = plain_tag(inside) if angle else None
            if tag is None:
                return False
            if tag[1] is None:
                self.handle_endtag(tag[0])
            else:
                self.opened(*tag)
            if text:
                self.at.children.append(unescape(text) if "&" in text else text)
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.opened(tag, {k: v or "" for k, v in attrs})

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        if self.at.tag in ENDS.get(tag, ()):
            self.handle_endtag(self.at.tag)
            if tag == "tr" and self.at.tag == "tr":
                self.handle_endtag("tr")
        node = Node(tag, attrs, self.at, self.order)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:  # an end without a beginning is passed over
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def link_id(node: Node | None) -> str | None:
    """The last part of a link's path."""
    href = node.attrs.get("href") or node.attrs.get("data-link") if node is not None else None
    return href.rstrip("/").rsplit("/", 1)[-1] or None if href else None


def people(node: Node) -> list[Node]:
    return list(node.all("a", test=lambda a: "/fighter-details/" in a.attrs.get("href", "")))


def number(text: str | None) -> int | None:
    found = re.search(r"-?\d+", text or "")
    return int(found[0]) if found else None


def shares(text: str | None) -> tuple[int | None, int | None]:
    found = re.search(r"(\d+)\s+of\s+(\d+)", text or "", re.IGNORECASE)
    return (int(found[1]), int(found[2])) if found else (None, None)


def seconds(text: str | None) -> int | None:
    found = re.fullmatch(r"(?:(\d+):)?(\d+):(\d+)", (text or "").strip())
    return int(found[1] or 0) * 3600 + int(found[2]) * 60 + int(found[3]) if found else None


def pair(cell: Node) -> list[str]:
    """The values of a cell that shows one for each side."""
    return [p.text() for p in cell.all("p")] or [cell.text()]


CARD = "position int, red_source string, red_name string, blue_source string, blue_name string, winner_source string, weight_class string, method string, end_round int, end_time string, detail string, is_title boolean"


def event_card(root: Node) -> Iterator[tuple]:
    """Bouts of a card. Red is the smaller source id, so that corners can't tell who won (a card lists the winner first)."""
    seen = set()
    for row in root.all("tr", test=lambda r: "data-link" in r.attrs):
        own, cells = people(row)[:2], row.cells()
        detail = link_id(row)
        if detail in seen or len(own) < 2 or len(cells) < 10:
            continue
        seen.add(detail)
        sides = [(link_id(a), a.text()) for a in own]
        flags = [f.text().lower() for f in row.all(cls="b-flag__text")]
        winner = sides[flags.index("win")][0] if "win" in flags[:2] and flags.count("win") == 1 else None
        if sides[0][0] and sides[1][0]:
            sides.sort(key=lambda s: s[0])
        method = " - ".join(x for x in pair(cells[7])[:2] if x) or None
        belt = any("belt" in i.attrs.get("src", "") for i in cells[6].all("img"))
        yield (len(seen), *sides[0], *sides[1], winner, cells[6].text() or None, method, number(cells[8].text()), cells[9].text() or None, detail, belt)


STATS = ("sig_landed", "sig_attempted", "td_landed", "td_attempted", "subs", "control", "knockdowns")
ROUNDS = "source string, name string, round int, " + ", ".join(f"{c} int" for c in STATS)
TOTALS = "source string, name string, " + ", ".join(f"{c} int" for c in STATS)


def overall(root: Node) -> Node | None:
    tables = list(root.all("table", "b-fight-details__table"))
    return next((t for t in tables if any(h.text() == "KD" for h in t.all("th"))), tables[0] if tables else None)


def stat_rows(root: Node) -> Iterator[tuple[int, list[tuple]]]:
    """For each row of statistics its round (from the marker before it, else its place) and both sides' values."""
    table = overall(root)
    if table is None:
        return
    mark, place = None, 0
    for n in table.all(test=lambda x: x.tag in ("thead", "tr")):
        if n.tag == "thead":
            found = re.search(r"round\s+(\d+)", n.text(), re.IGNORECASE)
            mark = int(found[1]) if found else mark
            continue
        cells = [c for c in n.cells() if c.tag == "td"]
        if len(cells) < 10:
            continue
        place += 1
        sides = []
        shown = {k: pair(cells[k]) + [None, None] for k in (1, 2, 5, 7, 9)}
        for i, a in enumerate(people(cells[0])[:2]):
            v = {k: x[i] for k, x in shown.items()}
            sides.append((link_id(a), a.text(), *shares(v[2]), *shares(v[5]), number(v[7]), seconds(v[9]), number(v[1])))
        yield mark or place, sides


def fight_rounds(root: Node) -> Iterator[tuple]:
    """Per round and side; nothing where the table has no round markers, as it then holds totals."""
    table = overall(root)
    if table is not None and table.first("thead", "b-fight-details__table-row_type_head") is not None:
        for k, sides in stat_rows(root):
            for s in sides:
                yield (*s[:2], k, *s[2:])


def fight_totals(root: Node) -> Iterator[tuple]:
    """Sums over the page's rows for each side; NULL where no row has the number."""
    sums: dict[tuple, list] = {}
    for _, sides in stat_rows(root):
        for s in sides:
            own = sums.setdefault(s[:2], [None] * len(STATS))
            for i, v in enumerate(s[2:]):
                own[i] = own[i] if v is None else (own[i] or 0) + v
    yield from ((*k, *v) for k, v in sums.items())


OFFICIALS = "referee string, judge string, red_source string, red_score int, blue_source string, blue_score int"


def officials(root: Node) -> Iterator[tuple]:
    """A row for each judge's card (one without a judge if there is none). Cards print the loser's score first; a page without exactly
    one winner of two persons tells no scores."""
    referee, cards = None, []
    for item in root.all("i", "b-fight-details__text-item"):
        label = item.first("i", "b-fight-details__label")
        if label is not None:
            if label.text().rstrip(":").lower() == "referee":
                referee = item.text()[len(label.text()):].strip() or None
            continue
        judge = item.first("span")
        score = re.search(r"(\d+)\s*-\s*(\d+)", item.text())
        if judge is not None and judge.text() and score:
            cards.append((judge.text(), int(score[1]), int(score[2])))
    persons = [(link_id(a), (p.first("i", "b-fight-details__person-status") or Node("", {}, None)).text().upper() == "W") for p in root.all(cls="b-fight-details__person") for a in people(p)[:1]]
    won = [i for i, p in enumerate(persons) if p[1]]
    anchored = len(persons) == 2 and len(won) == 1
    for judge, lost, gained in cards if anchored else []:
        scores = (gained, lost) if won[0] == 0 else (lost, gained)
        yield referee, judge, persons[0][0], scores[0], persons[1][0], scores[1]
    if referee and not (cards and anchored):
        yield referee, None, None, None, None, None


RANKINGS = "division string, champion string, rank int, name string, change int, mismatch boolean"


def rankings(root: Node) -> Iterator[tuple]:
    """Ranked names by division; the rank is the row's place. Of two blocks of a division the longer one counts."""
    blocks: dict[str, tuple[str | None, list]] = {}
    for g in root.all("div", "view-grouping"):
        header = g.first("div", "view-grouping-header")
        if header is None:
            continue
        division = re.sub(r"[^a-z0-9]+", "_", re.sub(r"\s*top rank\s*$", "", header.text(), flags=re.IGNORECASE).lower()).strip("_")
        box = g.first(cls="rankings--athlete--champion")
        champion = next((h.text() or None for h in box.all("h5")), None) if box is not None else None
        rows = []
        for r in g.all("tr"):
            name = r.first("td", "views-field-title")
            if name is None or not name.text():
                continue
            moved, shown = (r.first("td", f"views-field-weight-class-rank{x}") for x in ("-change", ""))
            change = number(moved.text()) if moved is not None else None
            if change is not None and "decreased" in moved.text().lower():
                change = -change
            place = len(rows) + 1
            rows.append((place, name.text(), change, bool(shown is not None and shown.text().isdigit() and int(shown.text()) != place)))
        before = blocks.get(division)
        kept = rows if before is None or len(rows) > len(before[1]) else before[1]
        blocks[division] = (champion or (before[0] if before else None), kept)
    for division, (champion, rows) in blocks.items():
        for r in rows:
            yield (division, champion, *r)


BONUSES = "kind string, name_1 string, name_2 string"
#: Labels of the awards, and what they stand for.
AWARDS = {"fight of the night": "FOTN", "performance of the night": "POTN", "knockout of the night": "POTN", "submission of the night": "POTN"}


def bonuses(root: Node) -> Iterator[tuple]:
    """Awards of the list behind the heading 'Bonus awards'."""
    begun = False
    for n in root.all(test=lambda x: x.tag in ("h2", "h3", "ul")):
        if n.tag != "ul":
            begun = n.text().lower().startswith("bonus awards")
        elif begun:
            for item in n.children:
                if not isinstance(item, Node) or item.tag != "li":
                    continue
                label, _, value = re.sub(r"\[\s*\w+\s*\]", "", item.text()).partition(":")
                kind = AWARDS.get(" ".join(label.lower().split()))
                if kind == "FOTN":
                    two = [x.strip() for x in re.split(r"\s+vs?\.?\s+", value.strip()) if x.strip()]
                    if len(two) == 2:
                        yield kind, *two
                elif kind:
                    for name in re.split(r",\s*(?:and\s+)?|\s+and\s+", value.strip()):
                        if name.strip():
                            yield kind, name.strip(), None
            return


INDEX = "url string, name string, day string, location string"


def events_index(root: Node) -> Iterator[tuple]:
    """Events of an index page, each link once."""
    seen = set()
    for row in root.all("tr"):
        a = row.first("a", test=lambda x: "/event-details/" in x.attrs.get("href", ""))
        if a is None or a.attrs["href"] in seen or not a.text():
            continue
        seen.add(a.attrs["href"])
        day, cells = row.first("span", "b-statistics__date"), row.cells()
        yield a.attrs["href"], a.text(), day.text() or None if day is not None else None, cells[1].text() or None if len(cells) > 1 else None


FIGHTERS = "source string, first string, last string, height string, weight string, stance string, wins int, losses int, draws int"


def fighters_index(root: Node) -> Iterator[tuple]:
    """Fighters of an index page: names, measures as written, and the record's three columns."""
    for row in root.all("tr"):
        own, cells = people(row), [c.text() or None for c in row.cells()]
        if own and len(cells) >= 10:
            yield link_id(own[0]), cells[0], cells[1], cells[3], cells[4], cells[6], number(cells[7]), number(cells[8]), number(cells[9])


def extract(pages: DataFrame, key: str, html: str, f: Callable[[Node], Iterator[tuple]], schema: str) -> DataFrame:
    """key and the records of f for each page; NULL and empty pages give none."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(b.column(1)):
                if text.is_valid:
                    for r in f(Page(text.as_py()).root):
                        keys.append(i)
                        rows.append(r)
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *cols], [key, *names])

    at = pages.select(key, F.col(html).cast("string"))
    return at.mapInArrow(run, f"{key} {at.schema[key].dataType.simpleString()}, {schema}")
