"""HTML bodies as flat event lists, and where each element of such a list ends.

Questions about nesting are answered on positions: an element is the range from its start event to the event that closes it, so
inheritance is a look at the enclosing range and a dropped region is a running balance over the list.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple


class Event(NamedTuple):
    kind: str  # start, end, text
    name: str  # the tag, or the text
    attrs: tuple = ()


def events(html: str | None) -> list[Event]:
    """Start tags, end tags and texts in order; comments and declarations are left out."""
    found: list[Event] = []
    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag = lambda tag, attrs: found.append(Event("start", tag, tuple(attrs)))
    reader.handle_endtag = lambda tag: found.append(Event("end", tag))
    reader.handle_data = lambda text: found.append(Event("text", text))
    reader.feed(html or "")
    reader.close()
    return found


def ranges(found: list[Event], childless: frozenset[str]) -> tuple[list[int], list[int]]:
    """For every event the start event around it (-1: none), and the event that ends each start's element.

    An end tag ends the nearest element of its name and whatever is still open inside it; without such an element it ends nothing. Elements
    that are never closed end with the list, those that cannot have children with themselves.
    """
    around, until, last = [], [len(found)] * len(found), -1
    for at, event in enumerate(found):
        if event.kind == "end":
            match = last
            while match >= 0 and found[match].name != event.name:
                match = around[match]
            if match >= 0:
                while last != around[match]:
                    until[last], last = at, around[last]
        around.append(last)
        if event.kind == "start":
            if event.name in childless:
                until[at] = at
            else:
                last = at
    return around, until


def hidden(found: list[Event], names: frozenset[str]) -> list[bool]:
    """Whether each event lies in a region that one of ``names`` opens; the opening and the closing tag belong to it."""
    steps = [(e.kind == "start") - (e.kind == "end") if e.name in names and e.kind != "text" else 0 for e in found]
    depth = list(accumulate(steps, lambda d, s: max(0, d + s), initial=0))
    return [before > 0 or after > 0 for before, after in zip(depth, depth[1:], strict=False)]
