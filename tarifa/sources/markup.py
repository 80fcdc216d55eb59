"""What a page's markup carries besides its text: script bodies, the templates around them, and meta tags, in one pass of the parser."""

from __future__ import annotations

import json
from html.parser import HTMLParser


class Carried(HTMLParser):
    """scripts: (attributes, body, attributes of the template around it or None); metas: the attributes of each meta tag; links: the addresses of anchors."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[dict, str, dict | None]] = []
        self.metas: list[dict] = []
        self.links: list[str] = []
        self._templates: list[dict] = []
        self._script: tuple[dict, list[str]] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "template":
            self._templates.append(dict(attrs))
        elif tag == "script":
            self._script = dict(attrs), []
        elif tag == "meta":
            self.metas.append({k: v or "" for k, v in attrs})
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._script:
            attributes, body = self._script
            self.scripts.append((attributes, "".join(body), self._templates[-1] if self._templates else None))
            self._script = None
        elif tag == "template" and self._templates:
            self._templates.pop()

    def handle_data(self, data: str) -> None:
        if self._script:
            self._script[1].append(data)

    def state(self):
        """The page's embedded state, if exactly one script has it."""
        found = [body for attributes, body, _ in self.scripts if attributes.get("id") == "__NEXT_DATA__"]
        return read_json(found[0]) if len(found) == 1 else None

    def linked_data(self) -> tuple[list, bool]:
        """The JSON-LD blocks, and whether one of them isn't JSON."""
        blocks, broken = [], False
        for attributes, body, _ in self.scripts:
            if "ld+json" in (attributes.get("type") or "").lower():
                value = read_json(body)
                broken |= value is None
                blocks += [] if value is None else [value]
        return blocks, broken


def read_json(body: str):
    try:
        return json.loads(body)
    except ValueError:
        return None


def followed(graph: dict, value, shape):
    """A value of a normalized graph, in which {type: id, id: key} stands for the entry of that key, as far as a shape asks for it.

    A shape is None (any plain value), a list of one shape (for all items) or a dict of shapes by field. References are followed where the shape
    goes and nowhere else, so neither cycles nor shared entries make it longer than the shape is deep.
    """
    passed = set()
    while isinstance(value, dict) and value.get("type") == "id" and isinstance(value.get("id"), str):
        key = value["id"]
        value = None if key in passed else graph.get(key)  # a reference that leads back to itself stands for nothing
        passed.add(key)
    if isinstance(shape, dict):
        return {k: followed(graph, value.get(k), s) for k, s in shape.items() if k in value} if isinstance(value, dict) else None
    if isinstance(shape, list):
        return [followed(graph, v, shape[0]) for v in value] if isinstance(value, list) else None
    return None if isinstance(value, (dict, list)) else value
