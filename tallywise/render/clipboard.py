"""The terminal's clipboard."""

from __future__ import annotations

import base64


def osc52(text: str) -> str:
    """The escape sequence that puts ``text`` on the clipboard of the terminal, also over a remote shell."""
    return f"\x1b]52;c;{base64.b64encode(text.encode()).decode()}\x07"
