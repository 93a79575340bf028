"""Raw mail messages as their reader sees them.

A small per-message helper used inside Arrow batches: Spark has no MIME
functions.  Everything that needs grouping, joining or counting happens in
Spark on what this yields.

Defined results: null or empty text gives no parts; a multipart without a
usable boundary is read as one plain body; parts are read at any depth; undecodable base64 is skipped; text
in a wrong character set is read as UTF-8, else as declared, else as latin-1.
"""

from __future__ import annotations

import binascii
import html
import re
from email.header import decode_header

_FOLD = re.compile(r"\n[ \t]+")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_NOT_B64 = re.compile(rb"[^A-Za-z0-9+/]")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|a|small|big|tt|code|sub|sup|wbr|o:p)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_UU = re.compile(r"^begin [0-7]{3,4} [^\n]*\n(.*?)^end[ \t]*$", re.M | re.S)
#: Characters without width that may stand inside a word.
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")


def _headers(block: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in _FOLD.sub(" ", block).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _split(message: str) -> tuple[dict[str, str], str]:
    if message.startswith("\n"):
        return {}, message[1:]
    head, _, body = message.partition("\n\n")
    return _headers(head), body


def _characters(data: bytes, content_type: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if declared := _CHARSET.search(content_type):
        try:
            return data.decode(declared[1])
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def _base64(body: str) -> bytes:
    data = _NOT_B64.sub(b"", body.encode("ascii", "ignore"))
    data = data[: len(data) - 1] if len(data) % 4 == 1 else data
    try:
        return binascii.a2b_base64(data + b"=" * (-len(data) % 4))
    except binascii.Error:
        return b""


def _decoded(headers: dict[str, str], body: str) -> str:
    coding = headers.get("content-transfer-encoding", "").strip().lower()
    if coding == "base64":
        return _characters(_base64(body), headers.get("content-type", ""))
    if coding == "quoted-printable":
        return _characters(binascii.a2b_qp(body.encode("utf-8", "replace")), headers.get("content-type", ""))
    return body


def strip_markup(page: str) -> str:
    """Readable text of an HTML page: inline tags vanish, other tags break the line."""
    page = _TAG.sub("\n", _INLINE.sub("", _HIDDEN.sub(" ", page)))
    return html.unescape(page)


def _uu_line(line: str) -> bytes:
    try:
        return b"" if not line.strip() else binascii.a2b_uu(line.encode("ascii", "ignore"))
    except binascii.Error:
        return b""


def _uudecoded(block: re.Match) -> str:
    data = b"".join(map(_uu_line, block[1].split("\n")))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "\n"
    return f"\n{text}\n" if text.isprintable() or not re.search("[\x00-\x08\x0e-\x1f]", text) else "\n"


def _inner(kind: str, headers: dict[str, str], body: str) -> list[str] | None:
    """The messages or parts inside a multipart or forwarded message; None for a leaf."""
    if kind.lower().startswith("message/"):
        return [_decoded(headers, body).lstrip("\n")]
    if kind.lower().startswith("multipart/") and (found := _BOUNDARY.search(kind)):
        pieces = ("\n" + body).split("\n" + "--" + (found[1] or found[2]))
        if len(pieces) > 1:
            end = next((i for i, piece in enumerate(pieces) if i and piece.startswith("--")), len(pieces))
            return [piece.lstrip(" \t")[1:] for piece in pieces[1:end]]
    return None


def _parts(message: str):
    """Texts of all text parts in order, however deep they lie: a stack, so depth is only bounded by the message itself."""
    waiting = [message]
    while waiting:
        headers, body = _split(waiting.pop())
        kind = headers.get("content-type", "text/plain").strip()
        lower = kind.lower()
        inside = _inner(kind, headers, body)
        if inside is not None:
            waiting += reversed(inside)
        elif lower.startswith(("text/", "multipart/")):
            text = _decoded(headers, body)
            if lower.startswith("text/html"):
                text = strip_markup(text)
            elif "begin " in text:
                text = _UU.sub(_uudecoded, text)
            yield text


def subject_of(headers: dict[str, str]) -> str:
    raw = headers.get("subject", "")
    if "=?" not in raw:
        return raw
    try:
        return "".join(part if isinstance(part, str) else _characters(part, f"charset={charset or 'utf-8'}") for part, charset in decode_header(raw))
    except (binascii.Error, ValueError, LookupError):
        return raw


def read_message(raw: str | None) -> tuple[str, list[str]]:
    """(subject, readable text of every text part in order) of one raw message."""
    if not raw:
        return "", []
    message = raw.replace("\r\n", "\n").replace("\r", "\n").lstrip("\n")
    headers, _ = _split(message)
    if not headers:
        return "", [message]
    return subject_of(headers), [_INVISIBLE.sub("", text) for text in _parts(message)]
