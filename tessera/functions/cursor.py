"""Request fingerprints and page cursors."""

from __future__ import annotations

import base64
import hashlib
import json

from ..settings import SearchRequest


def fingerprint(request: SearchRequest) -> str:
    """What a cursor is bound to: query, filters, facets, sort and typo tolerance, but no paging."""
    body = {"query": request.query, "filters": request.filters, "facets": sorted(request.facets), "sort": request.sort, "typo": request.typo}
    text = json.dumps({k: v for k, v in body.items() if v is not None}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode()[:24]


def encode_cursor(version: str, offset: int, request: SearchRequest) -> str:
    body = json.dumps({"version": version, "offset": offset, "queryFingerprint": fingerprint(request)})
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        ok = isinstance(body["version"], str) and isinstance(body["queryFingerprint"], str) and isinstance(body["offset"], int) and not isinstance(body["offset"], bool) and body["offset"] >= 0
    except (ValueError, KeyError, TypeError):
        ok = False
    if not ok:
        raise ValueError("Invalid cursor")
    return body


def start_of(request: SearchRequest, version: str) -> int:
    """The offset to read from; a cursor overrides the request's own."""
    if request.cursor is None:
        return request.offset
    body = decode_cursor(request.cursor)
    if body["version"] != version:
        raise ValueError("the cursor belongs to another index version")
    if body["queryFingerprint"] != fingerprint(request):
        raise ValueError("the cursor belongs to a different search request")
    return body["offset"]
