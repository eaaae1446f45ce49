"""Page cursors: opaque, and where signed, bound to the revision and the filters they were made for."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json


class BadCursor(ValueError):
    """A cursor that isn't one, or is another query's."""


def encode_keyset(weight: int, key: str) -> str:
    return base64.urlsafe_b64encode(f"{weight}:{key}".encode()).decode()


def decode_keyset(cursor: str) -> tuple[int, str]:
    try:
        weight, _, key = base64.urlsafe_b64decode(cursor.encode()).decode().partition(":")
        if not key:
            raise BadCursor(cursor)
        return int(weight), key
    except ValueError as e:
        raise BadCursor(cursor) from e


def filter_digest(filters: dict[str, object]) -> str:
    """The same for the same filters in any order; blank ones don't count."""
    kept = {k: v for k, v in filters.items() if v not in ("", None)}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sign(secret: bytes, revision: str, catalog: str, filters: dict[str, object], position: dict[str, object]) -> str:
    body = json.dumps({"revision": revision, "catalog": catalog, "filters": filter_digest(filters), "at": position}, sort_keys=True).encode()
    mark = hmac.new(secret, body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(mark + body).decode()


def verify(secret: bytes, cursor: str, revision: str, catalog: str, filters: dict[str, object]) -> dict[str, object]:
    """The position in the cursor; raises BadCursor unless it was made for this revision, catalog and filters."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
    except ValueError as e:
        raise BadCursor("not a cursor") from e
    mark, body = raw[:32], raw[32:]
    if not hmac.compare_digest(mark, hmac.new(secret, body, hashlib.sha256).digest()):
        raise BadCursor("not signed here")
    found = json.loads(body)
    if (found["revision"], found["catalog"], found["filters"]) != (revision, catalog, filter_digest(filters)):
        raise BadCursor("made for another revision, catalog or filter")
    return found["at"]


def page_limit(asked: int | None, default: int, most: int) -> int:
    """A limit in its range: the default where none is asked for."""
    return min(max(1, default if asked is None else asked), most)


class Moved(BadCursor):
    """A cursor of another revision or place; the reader has to begin anew."""


def pin(kind: str, start: int, **where: object) -> str:
    """A cursor of a region, community or entity read: where it goes on, and what it was made for."""
    return base64.urlsafe_b64encode(json.dumps({"kind": kind, "start": start, "where": where}, sort_keys=True).encode()).decode()


def pinned(kind: str, cursor: str | None, **where: object) -> int:
    """Where to go on; 0 without a cursor. Raises Moved for one that was made for something else."""
    if not cursor:
        return 0
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        start, made = int(found["start"]), found["where"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadCursor("not a cursor") from e
    if start < 0:
        raise BadCursor("not a cursor")
    if found.get("kind") != kind or made != json.loads(json.dumps(where)):
        raise Moved(f"made for {found.get('kind')} {made}")
    return start
