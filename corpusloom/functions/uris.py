"""Addresses of files in one form."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit


def file_uri(path: str) -> str:
    """A path, Windows path, network share or file address as a file address; others stay as they are."""
    text = path.strip()
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", text) and not text.lower().startswith("file://"):
        return text
    if text.lower().startswith("file://"):
        parts = urlsplit(text)
        text = ("//" + parts.netloc if parts.netloc and parts.netloc != "localhost" else "") + unquote(parts.path)
    text = text.replace("\\", "/") if re.match(r"^(?:[A-Za-z]:[\\/]|\\\\|//)", text) or "\\" in text and "/" not in text else text
    host = ""
    if text.startswith("//"):
        host, _, rest = text[2:].partition("/")
        text = "/" + rest
    if drive := re.match(r"^/?([A-Za-z]):/", text):
        text = f"/{drive[1].upper()}:{text[drive.end() - 1:]}"
    out: list[str] = []
    for part in text.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return f"file://{host.lower()}/" + quote("/".join(out), safe="/:~!$&'()*+,;=@-._")
