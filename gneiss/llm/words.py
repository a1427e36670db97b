"""Words as the operators of this subpackage take them: runs of anything but ASCII white space."""

from __future__ import annotations


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text, in UTF-8. bytes.split() splits at exactly those six characters."""
    return text.encode("utf-8", "replace").split() if text else []
