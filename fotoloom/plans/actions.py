"""Search requests out of an assistant's action list; the assistant itself is outside the engine."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from fotoloom.functions.predicates import has_gps
from fotoloom.operators.search import Spec

#: Actions that a request may hold, fixed values.
ALLOWED = ["set_bounds", "set_persons", "set_date_range", "set_formats", "clear_filters", "text_search"]
#: Actions of our own, for callers that allow them.
TAG_ACTIONS = ["set_tags", "exclude_tags"]
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?\Z|[{}\[\]]', re.S)


def closed_json(text: str) -> str:
    """A JSON text that broke off, closed: an open string, then the open brackets; a comma at the end goes."""
    due, last = [], ""
    for last in _TOKEN.findall(text):
        if last in ("{", "["):
            due.append("}" if last == "{" else "]")
        elif last in ("}", "]") and due:
            due.pop()
    broken = last.startswith('"') and text.endswith(last) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', last, re.S)
    text = text.removesuffix("\\") + '"' if broken else text.rstrip().removesuffix(",")
    return text + "".join(reversed(due))


def parse_actions(text: str, allowed: list[str] = ALLOWED) -> list[dict]:
    """Allowed actions of a reply, in order; a truncated reply is closed first; what stays unreadable has none."""
    for t in (text, closed_json(text or "")):
        try:
            found = json.loads(t)
        except (TypeError, ValueError):
            continue
        found = found.get("actions", []) if isinstance(found, dict) else []
        return [a for a in found if isinstance(a, dict) and a.get("type") in allowed]
    return []


def spec_of(actions: list[dict], base: Spec | None = None) -> tuple[Spec, str | None]:
    """The search the actions ask for, one after the other, and the text to search by vector, if any."""
    spec, text = base or Spec(), None
    for a in actions:
        match a["type"]:
            case "text_search":
                text = a.get("query")
            case "set_persons":
                spec.persons, spec.person_mode = a.get("person_ids", []), a.get("mode", "or")
            case "set_bounds":
                spec.box = (a["min_lat"], a["max_lat"], a["min_lon"], a["max_lon"])
            case "set_date_range":
                spec.date_from, spec.date_to = a.get("date_from"), a.get("date_to")
            case "set_formats":
                spec.formats = a.get("formats", [])
            case "set_tags":
                spec.tags = a.get("tag_ids", [])
            case "exclude_tags":
                spec.exclude_tags = a.get("tag_ids", [])
            case "clear_filters":
                spec, text = Spec(), None
    return spec, text


def recentred(box: tuple[float, float, float, float], lat: float, lon: float) -> tuple[float, float, float, float]:
    """The box (min_lat, max_lat, min_lon, max_lon) around a new centre."""
    h, w = (box[1] - box[0]) / 2, (box[3] - box[2]) / 2
    return lat - h, lat + h, lon - w, lon + w


def photo_lines(persons: Column, tags: Column) -> Column:
    """What is known of a photo as lines of text; unknown parts have no line."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label + ": "), c))
    position = F.when(has_gps(), F.format_string("%.6f, %.6f", "latitude", "longitude"))
    return F.concat_ws(
        "\n", line("File", F.col("file_name")), line("Taken", F.date_format("photo_date", "yyyy-MM-dd HH:mm")), line("Position", position),
        line("Size", F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))), line("Persons", persons), line("Tags", tags),
    )
