"""URI templates: {v} in place, {?a,b} and {&a,b} as query parameters."""

from __future__ import annotations

import re
from urllib.parse import quote


def expand(template: str, values: dict[str, str | None]) -> str:
    """Values percent-encoded; parameters without a value are left out."""

    def part(m: re.Match) -> str:
        kind, names = m[1], m[2].split(",")
        if not kind:
            return "".join(quote(str(values[n]), safe="") for n in names if values.get(n) not in (None, ""))
        given = [f"{n}={quote(str(values[n]), safe='')}" for n in names if values.get(n) not in (None, "")]
        return (kind if given else "") + "&".join(given)

    return re.sub(r"\{([?&]?)([^{}]+)\}", part, template)
